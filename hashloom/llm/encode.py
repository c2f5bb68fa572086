"""Token ids of whole texts with the ``tokenizers`` library, a batch of texts at a time.

The word-level vocabularies used here never let a token reach across ASCII white space, so a text's ids are those of
its white-space separated chunks in order.  A batch is split and its chunks are made distinct in Arrow; the library
encodes each distinct chunk once, many chunks to a call with a separator token between them; and the
ids are gathered back in numpy.  Three more properties keep the distinct chunks few and cheap: ASCII capitals may
be lowered first; a chunk that ends in an ASCII letter and plain punctuation has the letters' ids and then the punctuation's;
and a chunk of ASCII letters alone passes normaliser and pre-tokenizer unchanged.

Texts where these could fail (special-token openings; combining marks after ASCII letters) are encoded whole, and
so is everything if the tokenizer file fails the probes of these properties.  Tests compare with whole encoding.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PROBES = ("A don't  B\tcé\n ''s x1 23!? \x0b\x0c z, (ok)$$$ It's.", "The THE, the... theorem ÉCOLE, naïve-ish 3.14 a\x1cb c\x85d e\xa0f", "z. z,, z!? z$$$ z#*&%;: éé. İx")
TAILED = r"^(?P<base>.*[a-z])(?P<tail>[.,;:!?$%&*#]+)$"
MARK = "\x01"
JOINED = 256  # chunks to one call of the library
BATCH_BYTES = 8 << 20
GATHER = 500  # texts whose ids are gathered at once


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``flat[start[i] : start[i] + size[i]]`` for each i of ``index``, one after another."""
    n = size[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[index] - (ends - n), n) + np.arange(total)]


class TextEncoder:
    def __init__(self, path: str, end_id: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.letters = Tokenizer.from_str(self.tokenizer.to_str())
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = [t.encode(f" {MARK} ", add_special_tokens=False).ids for t in (self.tokenizer, self.letters)]
        self.mark = mark[0][0] if len(mark[0]) == 1 and mark[0] == mark[1] else None
        self.by_chunk = self.mark is not None
        if self.by_chunk:
            probes = pa.array(PROBES)
            self.by_chunk = all(np.array_equal(a, self._whole(t)) for a, t in zip(self._by_chunk(probes), PROBES, strict=True))

    def _whole(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32), self.end])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)`` of distinct chunks, in their order."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, c in enumerate(chunks):
            kinds[2 if MARK in c else 0 if c.isascii() and c.isalpha() and c.islower() else 1].append(k)
        sizes = np.zeros(len(chunks), np.int64)
        flats, order = [], []
        for tokenizer, at in ((self.letters, kinds[0]), (self.tokenizer, kinds[1])):
            for first in range(0, len(at), 64 * JOINED):
                part = at[first : first + 64 * JOINED]
                joined = [f" {MARK} ".join([chunks[k] for k in part[i : i + JOINED]]) + f" {MARK}" for i in range(0, len(part), JOINED)]
                ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
                marks = np.flatnonzero(ids == self.mark)
                sizes[part] = np.diff(marks, prepend=-1) - 1
                flats.append(ids[ids != self.mark])
                order.append(np.array(part))
        for k in kinds[2]:
            ids = np.array(self.tokenizer.encode(chunks[k], add_special_tokens=False).ids, np.uint32)
            sizes[k] = len(ids)
            flats.append(ids)
            order.append(np.array([k]))
        if not flats:
            return np.zeros(0, np.uint32), sizes
        order, flat = np.concatenate(order), np.concatenate(flats)
        start = np.zeros(len(chunks), np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(flat, start, sizes, np.arange(len(chunks))), sizes

    def _by_chunk(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        tailed = pc.extract_regex(coded.dictionary, TAILED)
        has = tailed.is_valid()
        base = pc.if_else(has, pc.struct_field(tailed, "base"), coded.dictionary).dictionary_encode()
        tail = pc.if_else(has, pc.struct_field(tailed, "tail"), "").dictionary_encode()
        chunks = base.dictionary.to_pylist() + tail.dictionary.to_pylist()
        flat, sizes = self._encode(chunks)
        start = np.cumsum(sizes) - sizes
        pairs = np.stack([base.indices.to_numpy(), tail.indices.to_numpy() + len(base.dictionary)], axis=1).astype(np.int64)
        # ids of whole chunks, and the end id as one more chunk
        ids = np.concatenate([gather(flat, start, sizes, pairs.ravel()), self.end])
        size = np.append(sizes[pairs].sum(axis=1), len(self.end))
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for at in range(0, len(texts), GATHER):
            cut = offsets[at : at + GATHER + 1]
            cells = np.insert(index[cut[0] : cut[-1]].astype(np.int64), cut[1:] - cut[0], len(size) - 1)
            got = gather(ids, begin, size, cells)
            ends = np.cumsum(size[cells])[(cut[1:] - cut[0]) + np.arange(len(cut) - 1)]
            yield from np.split(got, ends[:-1])

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids (uint32, the end id appended) of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            yield from map(self._whole, texts.to_pylist())
            return
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[̀-ͯ]")).to_numpy(zero_copy_only=False)
        if not odd.any():
            yield from self._by_chunk(texts)
            return
        rest = self._by_chunk(texts.filter(pa.array(~odd)))
        for k, is_odd in enumerate(odd):
            yield self._whole(texts[k].as_py()) if is_odd else next(rest)


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's texts take about ``size`` bytes in each (a longer text stands alone)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(at, end - at)
            at = end


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = 1) -> TextEncoder:
    return TextEncoder(path, end_id)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary lies; resolved on the machine that encodes."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids: np.ndarray) -> int:
    """Checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
