"""Tokenizing whole texts with the ``tokenizers`` library, each distinct chunk once.

A text is cut only where the tokenizer itself always starts a new pre-token, so the ids of a
text are the ids of its chunks in a row.  The two cuts:

* ``words``: at ASCII white space, for a lower-casing tokenizer that drops white space;
* ``spaced``: before a single space between two characters that aren't white space, for
  byte-level BPE, where that space opens the next pre-token.

Distinct chunks are found with Arrow; their ids are kept in a cache of bounded size in the
Python worker, and those that came again outlast the others.  Signs at a chunk's end are parted from
it.  New chunks of Latin letters go to the library's model as they are; other letters are encoded many
at a time in one text, and parted by the tokens that close (or open) a word; where that doesn't come
out even, one by one.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm.words import numbered_words, whole_texts

CACHE_CHUNKS, JOINED = 500_000, 500
#: Signs that are parted from the letter before them: all of ASCII's but those of contractions and special tokens.
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters of one code point in any case and normal form.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
ENDS_IN_LATIN, PLAIN = re.compile(f"[{LATIN}]\\Z"), {"words": re.compile(f"[{LATIN}]+"), "spaced": re.compile(f" [{LATIN}]+")}
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: The sign that stands for each byte in a byte-level vocabulary; a line feed is left, as it parts chunks.
BYTE_LEVEL = "".join("\n" if b == 10 else chr(_HIDDEN.get(b, b)) for b in range(256))
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = f"{_WHITE} | {_WHITE}|^ | $"
SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Encodes texts as arrays of ids; equal to encoding each whole text."""

    def __init__(self, path: str, cut: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cut = cut
        self.size = size = self._tokenizer.get_vocab_size()
        # Nothing but the model has a say in a plain word, unless some added token is one.
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._plain = not any(t.strip().isalpha() for t in added)
        marks = lambda t: t.endswith("</w>") if cut == "words" else t.startswith("Ġ")
        self._marked = np.array([marks(self._tokenizer.id_to_token(i) or "") for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._flat, self._start, self._length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._again = np.zeros(0, bool)  # which chunks were looked up after the batch that brought them

    def _shrink(self) -> None:
        """Keep the chunks that came again, unless they are most of the cache."""
        again = np.flatnonzero(self._again)
        if 2 * len(again) > CACHE_CHUNKS:
            return self._clear()
        kept = list(compress(self._number, self._again.tolist()))  # numbers go up in the dict's order
        flat, lengths = self._gather(again), self._length[again]
        self._clear()
        self._add(kept, flat, lengths)

    def _even(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct chunks, the number of each chunk in turn, chunks per text), cut with Arrow."""
        if self._cut == "words":
            numbers, words, counts = numbered_words(texts, lower=True)
            return words.to_numpy(zero_copy_only=False).tolist(), numbers, counts
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        numbers, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        opening = np.cumsum(counts) - counts  # the first chunk of a text has no space before it
        bare, number_of = np.unique(numbers[opening], return_inverse=True)
        numbers[opening] = len(words) + number_of
        return [" " + w for w in words] + [words[i] for i in bare.tolist()], numbers, counts

    def _odd(self, text: str) -> list[str]:
        if self._cut == "words":
            return [c for c in text.replace("\n", " ").split(" ") if c]
        pieces = SPACE_BETWEEN.split(text) if text else []
        return pieces[:1] + [" " + p for p in pieces[1:]]

    def _add(self, chunks: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self._start = np.concatenate([self._start, len(self._flat) + np.cumsum(lengths) - lengths])
        self._flat, self._length = np.concatenate([self._flat, flat]), np.concatenate([self._length, lengths])
        self._again = np.concatenate([self._again, np.zeros(len(lengths), bool)])
        self._number.update(zip(chunks, range(len(self._number), len(self._number) + len(chunks))))

    def _encode_each(self, chunks: list[str]) -> None:
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(chunks, np.fromiter((x for own in ids for x in own), np.uint32, int(lengths.sum())), lengths)

    def _encode_plain(self, chunks: list[str]) -> None:
        """Chunks of Latin letters only (cut as ``spaced``: after a space): each is one pre-token as it is, so the model's
        merges are all there is to do."""
        if not chunks:
            return
        text = "\n".join(chunks)
        shown = codecs.charmap_decode((text.lower() if self._cut == "words" else text).encode(), "strict", BYTE_LEVEL)[0]
        merge, ids, lengths = self._tokenizer.model.tokenize, array("I"), array("q")
        for word in shown.split("\n"):
            own = merge(word)
            lengths.append(len(own))
            ids.extend([t.id for t in own])
        self._add(chunks, np.frombuffer(ids, np.uint32), np.frombuffer(lengths, np.int64))

    def _encode_joined(self, chunks: list[str]) -> None:
        """Chunks of letters only (after the space, if it is cut ``spaced``)."""
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        glue, added = " " if self._cut == "words" else "", []
        for group, encoded in zip(groups, self._tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype=np.uint32)
            at = np.flatnonzero(self._marked[ids])
            if len(at) != len(group):
                self._encode_each(group)
            else:
                added.append((group, ids, np.diff(at, prepend=-1) if self._cut == "words" else np.diff(at, append=len(ids))))
        if added:
            in_groups, ids, lengths = zip(*added)
            self._add([c for group in in_groups for c in group], np.concatenate(ids), np.concatenate(lengths))

    def _learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks that are not known yet."""
        known, opening, n_known = self._number, self._cut == "spaced", len(self._number)
        # Signs after a letter, with nothing behind them, are a pre-token of their own.
        heads = [c.rstrip(SIGNS) for c in chunks]
        closed = [(c, h, c[len(h) :]) for c, h in zip(chunks, heads) if len(h) < len(c) and ENDS_IN_LATIN.search(h)]
        if closed:
            parted, heads, tails = zip(*closed)
            whole = set(chunks).difference(parted)
            whole.update(part for part in {*heads, *tails} if part not in known)
            chunks = list(whole)
        if self._plain:
            plain = list(map(PLAIN[self._cut].fullmatch, chunks))
            self._encode_plain([c for c, own in zip(chunks, plain) if own])
            chunks = [c for c, own in zip(chunks, plain) if not own]
        letters = [(c[1:] if opening else c).isalpha() and (not opening or c[:1] == " ") for c in chunks]
        if any(letters):
            self._encode_joined(list(compress(chunks, letters)))
        if not all(letters):
            self._encode_each([c for c, own in zip(chunks, letters) if not own])
        if closed:
            a, b = (np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in (heads, tails))
            for own in (a, b):
                self._again[own[own < n_known]] = True
            self._add(list(parted), self._gather(np.stack([a, b], axis=1).ravel()), self._length[a] + self._length[b])

    def _gather(self, which: np.ndarray) -> np.ndarray:
        lengths = self._length[which]
        place = np.cumsum(lengths) - lengths
        return self._flat[np.repeat(self._start[which] - place, lengths) + np.arange(int(lengths.sum()))]

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and the number of each text's ids."""
        if len(self._number) > CACHE_CHUNKS:
            self._shrink()
        column = whole_texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        # Lower-casing could make a special token of what is none.
        odd = pc.match_substring(column, "<|") if self._cut == "words" else pc.match_substring_regex(column, UNEVEN)
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        chunks, numbers, counts = self._even(column.filter(pa.array(~odd)) if odd.any() else column)
        cut = {i: self._odd(column[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        all_chunks = chunks + [c for own in cut.values() for c in own]
        cached = np.fromiter(map(self._number.get, all_chunks, repeat(-1)), np.int64, len(all_chunks))
        unknown = np.flatnonzero(cached < 0)
        self._again[cached[cached >= 0]] = True
        if len(unknown):
            new = [all_chunks[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)) if cut else new)
            cached[unknown] = np.fromiter(map(self._number.__getitem__, new), np.int64, len(new))
        n_chunks = np.zeros(len(texts), np.int64)
        n_chunks[~odd], n_chunks[odd] = counts, [len(own) for own in cut.values()]
        text_of = np.repeat(np.arange(len(texts)), n_chunks)
        which = np.empty(len(text_of), np.int64)
        from_odd = odd[text_of]
        which[~from_odd], which[from_odd] = cached[numbers], cached[len(chunks) :]
        lengths = self._length[which]
        n_ids = np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(n_ids.sum()), end_id, dtype=np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(n_ids) - 1] = False
        out[inside] = self._gather(which)
        return out, n_ids


@lru_cache(maxsize=4)
def chunk_tokenizer(path: str, cut: str) -> ChunkTokenizer:
    return ChunkTokenizer(path, cut)


def batches(texts: list[str], max_chars: int = 8_000_000):
    """(first, last) of runs of texts of about ``max_chars`` characters, a longer text alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > max_chars:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
