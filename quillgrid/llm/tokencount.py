"""Token counts: stable segments counted once per block, huge documents by overlapping chunks that are spliced.

For a piece model whose normaliser changes nothing and whose pieces hold the space
mark only at their start (both checked when the file is opened), no merge crosses a
place where a space follows another character: such a boundary is stable.  A
document up to ``chunk`` bytes is counted as the sum over its segments between
stable boundaries, each distinct segment encoded once per block.

A longer document is encoded in chunks of ``chunk`` bytes that overlap by
``overlap`` on either side, with offsets.  Neighbours are spliced at the stable token
boundary, common to both encodings, that is nearest to the middle of their overlap;
if there is none the overlap is doubled and both are encoded again, up to the whole
document.  Any other model or a ``.json`` tokenizer is counted whole by its library.

Defined cases: null and empty texts have no tokens and no bytes; null and repeated
ids are ordinary rows; an empty table gives an empty result; columns other than the
named ones play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import map_arrow, narrow

U = np.uint64
MARK = "▁"
_MARK = MARK.encode()
#: Bytes of a chunk and of an overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Segments whose counts a worker remembers between blocks; then it starts anew.
MEMORY = 400_000


class Counter:
    """A tokenizer file, opened once in each process."""

    def __init__(self, path: str) -> None:
        self.memory: dict[bytes, int] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer, self.stable = Tokenizer.from_file(path), False
            self.tokenizer.no_padding()
            self.tokenizer.no_truncation()
            return
        import sentencepiece

        self.tokenizer = None
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        joined = any(MARK in p[1:] and p.strip(MARK) for p in known)
        probe = f"a  b ﬁ　 {MARK}c "  # a normaliser would change this; without one, only spaces become marks
        pieces = self.model.encode(probe, out_type=str)
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.stable = not joined and "".join(pieces) == MARK + probe.replace(" ", MARK)

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by the library alone."""
        if self.tokenizer is not None:
            return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def offsets(self, text: bytes) -> np.ndarray:
        """First byte of each token of ``text``, and its length."""
        return np.array([*(p.begin for p in self.model.encode(text.decode(), return_type="proto").pieces), len(text)])

    def segments(self, texts: list[bytes]) -> np.ndarray:
        """Counts of texts (UTF-8), by their segments between stable boundaries."""
        marked = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]  # the model reads both as its mark, and adds one in front
        data = np.frombuffer(b"".join(marked), dtype=np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in marked])).astype(np.int64)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(first)
        stop = np.append(at[1:], len(data))
        hashes = tb.sums(tb.BYTES[data], at, stop)
        _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        flat = data.tobytes()
        if not tb.equal(data, at, stop, where, back):  # two segments with one hash
            where = back = np.arange(len(at))
        keys = [flat[a + 1 : b] for a, b in zip(at[where].tolist(), stop[where].tolist(), strict=True)]
        fresh = [k for k in keys if k not in self.memory]
        if len(self.memory) + len(fresh) > MEMORY:
            self.memory, fresh = {}, keys
        self.memory |= zip(fresh, self.whole([k.decode() for k in fresh]), strict=True)
        if b"" in self.memory:  # one space at a text's end: the mark alone, which the model does not add to an empty text
            self.memory[b""] = self.alone
        counts = np.fromiter((self.memory[k] for k in keys), np.int64, len(keys))[back]
        sums = np.append(0, np.cumsum(counts))
        bounds = np.searchsorted(at, offsets)
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def spliced(self, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of a long text (UTF-8) from overlapping chunks."""
        total, at, n = 0, 0, len(text)  # tokens before ``at``, a stable boundary, are counted
        while True:
            wide, end = overlap, min(n, at + chunk)
            while True:
                stop = _whole_char(text, min(n, end + wide))
                left = self._encoded(text, at, stop)
                if stop == n:
                    return total + len(left) - 1
                back = _whole_char(text, max(at, end - wide))
                right = self._encoded(text, back, _whole_char(text, min(n, stop + wide)))
                common = np.intersect1d(left[1:-1], right[1:-1])
                common = common[(common > back) & (common < stop)]
                common = [i for i in common.tolist() if _stable(text, i)]
                if common:
                    break
                wide *= 2
            cut = min(common, key=lambda i: abs(i - end))
            total += int(np.searchsorted(left, cut))
            at = cut

    def _encoded(self, text: bytes, a: int, b: int) -> np.ndarray:
        """Token starts of text[a:b] in the text, and b; the mark that the model adds stands for a space at a > 0."""
        space = a > 0 and (1 if text[a] == 0x20 else 3 if text[a : a + 3] == _MARK else 0)
        if space and b == a + space:
            return np.array([a] * self.alone + [b])
        starts = self.offsets(text[a + space : b]) + a + space
        if space:
            starts[0] = a
        return starts

    def counts(self, texts: list[bytes], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        if not self.stable:
            return np.array(self.whole([t.decode() for t in texts]), np.int64)
        huge = [i for i, t in enumerate(texts) if len(t) > chunk]
        out = self.segments([b"" if len(t) > chunk else t for t in texts])
        for i in huge:
            out[i] = self.spliced(texts[i], chunk, overlap)
        return out


def _whole_char(text: bytes, i: int) -> int:
    """The last start of a character at or before i."""
    while 0 < i < len(text) and text[i] & 0xC0 == 0x80:
        i -= 1
    return i


def _stable(text: bytes, i: int) -> bool:
    """Whether a space or mark at i follows another character."""
    return (text[i] == 0x20 or text[i : i + 3] == _MARK) and text[i - 1] != 0x20 and text[i - 3 : i] != _MARK


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            data, offsets = tb.raw(batch.column(1))
            for a, b in tb.runs(offsets, 2 * tb.BLOCK):
                texts = [data[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                found = model.counts(texts, chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``; no shuffle."""
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return map_arrow(base, _count(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
