"""Token ids by a public tokenizer, each distinct word of a batch encoded once.

The tokenizer drops white space and never joins what white space parts, so a text's ids are those of its
space-separated words one after another. A batch of texts is split into words and the words are numbered by Arrow; only
its distinct words are looked at in Python, and their ids are put together again by array indexing.

A distinct word is a core of letters with perhaps marks after it, mostly. Such cores go to the tokenizer's model in lower
case, all at once; the model marks each word's last piece, which parts them again. Any other word
goes through the whole tokenizer, parted by the tokenizer's own end token, which cuts its input before anything else
happens to it. A text that holds the beginning of a special string is encoded as a whole. What a worker remembers from
batch to batch is bounded by ``REMEMBER`` words.
"""

from __future__ import annotations

import ctypes
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBER = 800_000
PIECE_BYTES = 1 << 23
AT_ONCE = 1 << 14
SPECIAL = "<|"  # how every special string of the vocabulary begins
MARKS = ".,;:!?"
_CODERS: dict[str, WordCoder] = {}


class WordCoder:
    """Encodes texts to ids."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.apart = "<|endoftext|>"
        self.apart_id = self.tokenizer.token_to_id(self.apart)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _core(word: str) -> str | None:
        """The word in lower case, if the tokenizer makes one pre-token of it and lower-cases letter by letter."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        low = word.lower()
        return low if low.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word) else None

    @staticmethod
    def _parted(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def forget(self) -> None:
        """Gives back what is remembered, so that an idle worker leaves room for what runs next in its executor."""
        self.known = {}
        pa.default_memory_pool().release_unused()
        _trim()

    def _of_cores(self, cores: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(cores), AT_ONCE):
            some = cores[lo : lo + AT_ONCE]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            out += self._parted(ids, np.append(0, ends[:-1]), ends)
        return out

    def _of_others(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), AT_ONCE):
            ids = np.array(self.tokenizer.encode_batch_fast([self.apart.join(words[lo : lo + AT_ONCE])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.apart_id)
            out += self._parted(ids, np.append(0, at + 1), np.append(at, len(ids)))
        return out

    def _units(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of distinct words: the ids of units, and for each word its first unit and the unit after that."""
        coded = pc.dictionary_encode(pc.utf8_rtrim(words, characters=MARKS))
        first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        cores = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBER:
            self.known = {}
        known = self.known
        units = list(map(known.get, cores))
        missing = [i for i, u in enumerate(units) if u is None]
        low = [self._core(cores[i]) for i in missing]
        fresh = list(set(low) - {None})
        of: dict[str | None, bytes] = dict(zip(fresh, self._of_cores(fresh), strict=True))
        of[None] = b""  # not of letters
        for i, x in zip(missing, low, strict=True):
            units[i] = known[cores[i]] = of[x]
        # words whose core isn't one of letters are units themselves; other words may have marks as second unit
        odd = (np.fromiter(map(len, units), np.int32, len(units)) == 0)[first]
        rest = pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[first]
        second = np.full(len(words), len(units), np.int32)
        units.append(b"")
        strange = words.filter(pa.array(odd)).to_pylist()
        first[odd] = len(units) + np.arange(len(strange))
        units += self._of_others(strange)
        one, more = np.flatnonzero(~odd & (rest == 1)), np.flatnonzero(~odd & (rest > 1))
        marks = pc.dictionary_encode(pc.utf8_slice_codeunits(words.take(pa.array(one)), -1))
        second[one] = len(units) + marks.indices.to_numpy(zero_copy_only=False)
        tails = {m: i for i, m in enumerate(marks.dictionary.to_pylist())}
        second[more] = [len(units) + tails.setdefault(w[len(w.rstrip(MARKS)) :], len(tails)) for w in words.take(pa.array(more)).to_pylist()]
        return units + self._of_others(list(tails)), first, second

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: strings, none null. The ids (unsigned 32-bit) of all, and where each text's begin and end."""
        special = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        whole = {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(special).tolist()}
        if whole:
            texts = pc.if_else(pa.array(special), "", texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = coded.indices.to_numpy(zero_copy_only=False)
        units, first, second = self._units(coded.dictionary)
        sizes = np.fromiter(map(len, units), np.int32, len(units)) // 4
        pool = np.frombuffer(b"".join(units), "<u4")
        firsts = np.cumsum(sizes, dtype=np.int32) - sizes
        row = np.stack([first[at], second[at]], 1).ravel()
        taken = sizes[row]
        ends = np.cumsum(taken, dtype=np.int32)
        place = np.repeat(firsts[row] - ends + taken, taken)
        place += np.arange(len(place), dtype=np.int32)
        ids = pool[place]
        offsets = np.append(0, ends)[2 * bounds]
        if whole:
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


def in_pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose strings have about ``PIECE_BYTES`` bytes at most, a longer one alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(batch):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _lean() -> None:
    """Large buffers go back to the system when they are freed (glibc; elsewhere nothing happens). Otherwise a worker keeps
    what its largest batch took, beside the executor's heap."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def coder(vocabulary: str) -> WordCoder:
    """The worker's own, kept for its next tasks."""
    if vocabulary not in _CODERS:
        _CODERS.clear()
        _lean()
        _CODERS[vocabulary] = WordCoder(vocabulary)
    return _CODERS[vocabulary]


def encoded(batch: pa.RecordBatch, column: int, code: WordCoder, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch in slices, with the ids of each string and the end id after them."""
    tail = np.array([end_id], "<u4")
    for part in in_pieces(batch, column):
        ids, at = code.encode(part.column(column))
        yield part, [np.concatenate([ids[s:e], tail]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        pa.default_memory_pool().release_unused()
