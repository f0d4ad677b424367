"""Byte-level BPE over a distinct-word table: split once, encode each distinct word once, join ids back by position.

``encode`` works in blocks of consecutive documents of a partition:

1. each block is split into words (vectorised, exactly the tokenizer's own
   pre-tokenizer) and writes two kinds of rows: its distinct words, and each
   document as packed positions in that word list;
2. the words are shuffled by hash bucket.  A word is sent once by each block,
   however frequent it is, and is encoded once where its bucket's rows meet;
3. ids and documents meet again by block, and positions turn into ids.

Only distinct words and packed positions are shuffled, never texts or word
occurrences; no task holds more than one block.  Both row kinds come from the same
scan, computed for either, so a block carries a fingerprint of its contents: if the
input were not the same at both reads the job fails instead of joining wrong ids.

``decode`` joins ids with the id-to-piece table, which has one row per vocabulary
entry and so a fixed size; the join is a gather from the broadcast table.

Defined cases: null and empty texts have no ids and decode to ""; null and repeated
document ids are ordinary rows, each row gets its own result; empty tables give
empty results; columns other than the named ones play no part.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import map_arrow, narrow

U = np.uint64
#: Code points split at once, and code points of a block of documents.
PIECE, BLOCK = 1 << 18, 8_000_000
#: White space as the pre-tokenizer sees it (fixed values): U+0009-000D, 0020, 0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    for c in range(sys.maxunicode + 1):
        if (kind := kinds.get(unicodedata.category(chr(c))[0])) is not None:
            table[c] = kind
    table[_WHITE] = _SPACE
    return table


def split(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Start of every word of texts laid end to end; ``starts`` are the texts' own starts (none empty).

    Words are runs of letters, of numbers or of other characters, with one leading
    space, contractions after an apostrophe, and runs of white space, whose last
    character belongs to the next word if it is a space.
    """
    n = len(codes)
    kind = _classes()[codes]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[starts] = True
    ends = np.zeros(n + 1, dtype=bool)  # a text ends before this position
    ends[starts] = True
    ends[n] = True
    run = np.flatnonzero(first)
    stop = np.append(run[1:], n)
    white = (kind[run] == _SPACE) & ~ends[stop]
    last = stop[white] - 1
    first[last] = True
    attached = last[codes[last] == 0x20] + 1
    first[attached] = False
    # contractions: a lone apostrophe that starts a word, and letters after it
    mark = run[(codes[run] == 0x27) & (stop - run == 1)]
    mark = mark[first[mark] & (mark + 1 < n)]
    mark = mark[~ends[mark + 1] & (kind[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        one = codes[mark + 1]
        inside = (mark + 2 < n) & ~ends[np.minimum(mark + 2, n)]
        two = np.where(inside, codes[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        hit = size > 0
        mark, size = mark[hit], size[hit]
        first[mark + 1] = False
        after = mark + 1 + size
        ok = after < n
        after = after[ok]
        rest = (kind[after] == _LETTER) & ~ends[after]
        first[after[rest]] = True
    return np.flatnonzero(first)


class Vocabulary:
    """The tokenizer file, read once in each process: encodes words, and knows each id's bytes.

    Words are merged by ranks where ids stand in the order of the merges, which gives the
    library's ids about eight times as fast; else the library itself encodes them, and is
    loaded only then.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        if config["model"]["type"] != "BPE" or config["pre_tokenizer"]["type"] != "ByteLevel" or config["pre_tokenizer"]["add_prefix_space"] or config["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.path = path
        self.added = {x["content"]: x["id"] for x in config["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocab = {p: i for p, i in config["model"]["vocab"].items() if p not in self.added}
        pieces = {i: bytes(chars[c] for c in p) if all(c in chars for c in p) else p.encode() for p, i in vocab.items()}
        pieces |= {i: p.encode() for p, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.core = self._core(config["model"]["merges"], vocab)
        self.library = None

    def _core(self, merges: list, vocab: dict[str, int]):  # noqa: ANN202
        try:
            import tiktoken
        except ModuleNotFoundError:
            return None
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        plain = {i: p for i, p in enumerate(self.pieces) if i not in self.added.values()}
        if [vocab.get(m) for m in made] != list(range(256, 256 + len(made))) or len(plain) != 256 + len(made) or len(set(plain.values())) != len(plain):
            return None
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={p: i for i, p in plain.items()}, special_tokens={})._core_bpe

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words as ``split`` makes them, or of added tokens."""
        if self.core is not None:
            one, added = self.core.encode_single_piece, self.added
            return [one(w.encode()) if w not in added else [added[w]] for w in words]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_padding()
            self.library.no_truncation()
        return [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Vocabulary(path)


def _segments(text: str, added: dict[str, int]) -> list[str]:
    """The text cut around added tokens, which stand as segments of their own."""
    out = [text]
    for token in added:
        out = [y for x in out for y in ([x] if x in added else [z for i, part in enumerate(x.split(token)) for z in ([token] * (i > 0) + [part] * bool(part))])]
    return out


class Block:
    """Documents of a partition as positions in a growing list of distinct words."""

    def __init__(self, added: dict[str, int]) -> None:
        self.added, self.docs, self.size = added, [], 0
        self.words: dict[str, int] = {}

    def add(self, texts: list[str]) -> None:
        """All of ``texts``; together at most PIECE code points, or one text."""
        marked = any(token in text for token in self.added for text in texts)
        segments = [_segments(t, self.added) if marked else [t] for t in texts]
        flat = [s for x in segments for s in x if s]
        counts = [sum(map(bool, x)) for x in segments]
        joined = "".join(flat)
        self.size += len(joined)
        if not joined:
            self.docs += [np.zeros(0, np.uint32) for _ in texts]
            return
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        starts = np.cumsum(lengths) - lengths
        at = split(codes, starts)
        if marked:
            whole = [i for i, s in enumerate(flat) if s in self.added]
            for i in whole:
                a, b = starts[i], starts[i] + lengths[i]
                at = at[(at <= a) | (at >= b)]
        stop = np.append(at[1:], len(codes))
        values = codes * U(0x9E3779B97F4A7C15)
        values ^= values >> U(29)
        hashes = tb.sums(values, at, stop)
        del values
        _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not tb.equal(codes, at, stop, where, back):  # two words with one hash
            where = back = np.arange(len(at))
        words = self.words
        index = np.fromiter((words.setdefault(joined[a:b], len(words)) for a, b in zip(at[where].tolist(), stop[where].tolist(), strict=True)), np.uint32, len(where))
        found = index[back]
        bounds = np.searchsorted(at, np.append(starts, len(codes)))
        edges = np.cumsum([0, *counts])
        self.docs += [found[bounds[edges[i]] : bounds[edges[i + 1]]] for i in range(len(texts))]

    def close(self) -> tuple[list[str], list[np.ndarray]]:
        """Words by falling frequency, and each document's places in that order."""
        counts = np.zeros(len(self.words), np.int64)
        for lo in range(0, len(self.docs), 1024):
            counts += np.bincount(np.concatenate(self.docs[lo : lo + 1024]), minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        listed = list(self.words)
        return [listed[i] for i in order.tolist()], [rank[d] for d in self.docs]


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts that are split together."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > PIECE:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


def _blocks(batches: Iterator[pa.RecordBatch], added: dict[str, int]) -> Iterator[tuple[Block, pa.Array, int]]:
    """Blocks with their ids and their partition's number."""
    block, ids, partition = Block(added), [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = ["" if t is None else t for t in part.column(1).to_pylist()]
            partition = part.column(2)[0].as_py()
            for some in _pieces(texts):
                block.add([texts[i] for i in some])
                ids.append(part.column(0).slice(some[0], len(some)))
                if block.size >= BLOCK:
                    yield block, pa.concat_arrays(ids), partition
                    block, ids = Block(added), []
    if ids:
        yield block, pa.concat_arrays(ids), partition


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32 by byte planes, deflated."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = 4 - next((i for i in range(4) if planes[3 - i].any()), 4)
    return zlib.compress(planes[:used].tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    planes = np.zeros((4, n), dtype=np.uint8)
    used = len(flat) // n if n else 0
    planes[:used] = flat.reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


#: Distinct words are dealt out by hash in so many buckets, or as many as there are shuffle partitions; a bucket's rows are one for each block that has any.
BUCKETS = 1024
#: Words of a bucket whose ids a task remembers; then it starts anew.
MEMORY = 300_000
#: Words of documents that travel in one row.
GROUP = 1 << 16
_WORDS = "bucket int, block long, n int, places binary, lengths binary, words binary"
_JOINED = "block long, kind int, n int, places binary, lengths binary, data binary, doc_ids array<long>"


def _block_key(partition: int, number: int, words: list[str]) -> int:
    """From where the block lies and what it holds."""
    seed = partition.to_bytes(4, "big") + number.to_bytes(4, "big") + len(words).to_bytes(8, "big")
    return int.from_bytes(hashlib.blake2b(seed + "\0".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def _word_rows(added: dict[str, int], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block the distinct words with their places, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (block, _, partition) in enumerate(_blocks(batches, added)):
            words, _ = block.close()
            key = _block_key(partition, number, words)
            bucket = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % buckets
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                places = np.sort(by[edges[k] : edges[k + 1]])
                some = [words[i].encode() for i in places.tolist()]
                rows.append((k, key, len(some), _pack(places), _pack(np.fromiter(map(len, some), np.int64, len(some))), zlib.compress(b"".join(some), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())], ["bucket", "block", "n", "places", "lengths", "words"])

    return run


def _joined(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["block", "kind", "n", "places", "lengths", "data", "doc_ids"])


def _doc_rows(added: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block the documents as packed places, some documents in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (block, ids, partition) in enumerate(_blocks(batches, added)):
            words, docs = block.close()
            key, ids = _block_key(partition, number, words), ids.to_pylist()
            a = 0
            while a < len(docs):
                b, size = a + 1, len(docs[a])
                while b < len(docs) and size + len(docs[b]) <= GROUP and b - a < 4096:
                    size += len(docs[b])
                    b += 1
                flat = np.concatenate(docs[a:b])
                yield _joined([(key, 1, len(flat), _pack(flat), _pack(np.array([len(d) for d in docs[a:b]])), b"", ids[a:b])])
                a = b

    return run


def _encode_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket: each word is encoded once, and its ids go to each of its blocks.  Holds words of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        found: dict[str, np.ndarray] = {}
        held = None
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                for bucket, block, n, places, lengths, words in zip(*(c.to_pylist() for c in batch.slice(a, 64).columns), strict=True):
                    end = np.cumsum(_unpack(lengths, n), dtype=np.int64)
                    flat = zlib.decompress(words)
                    rows.append((bucket, block, n, places, [flat[x:y].decode() for x, y in zip([0, *end.tolist()], end.tolist(), strict=False)]))
                if rows[0][0] != held or len(found) > MEMORY:
                    found = {}
                fresh = list({w: None for r in rows for w in r[4] if w not in found})
                found |= {w: np.array(x, dtype=np.uint32) for w, x in zip(fresh, vocab.encode(fresh), strict=True)}
                out = []
                for _, block, n, places, words in rows:
                    ids = [found[w] for w in words]
                    out.append((block, 0, n, places, _pack(np.fromiter(map(len, ids), np.int64, n)), _pack(np.concatenate(ids)), None))
                if rows[-1][0] != rows[0][0]:
                    found = {w: found[w] for r in rows if r[0] == rows[-1][0] for w in r[4]}
                held = rows[-1][0]
                yield _joined(out)

    return run


def gather(ids: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The concatenation of ids[offsets[p] : offsets[p + 1]] for all places p."""
    size = (offsets[1:] - offsets[:-1])[places]
    total = int(size.sum())
    if not total:
        return ids[:0]
    shift = np.repeat(offsets[:-1][places] - (np.cumsum(size) - size), size)
    return ids[np.arange(total) + shift]


def _join_rows(shared=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Rows sorted by block and kind: a block's word ids, then its documents; with their texts if pieces are ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, table, offsets = None, [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind, n, places, lengths, data, doc_ids = (c[i].as_py() for c in batch.columns)
                if block != key:
                    key, parts, table = block, [], None
                if kind == 0:
                    size = _unpack(lengths, n)
                    parts.append((_unpack(places, n), size, _unpack(data, int(size.sum()))))
                    continue
                if table is None:
                    table, offsets = _table(parts)
                    parts = []
                where = _unpack(places, n)
                if n and int(where.max()) >= len(offsets) - 1:
                    raise RuntimeError("a block has no words: the input changed between two reads")
                ends = np.cumsum(_unpack(lengths, len(doc_ids)), dtype=np.int64)
                sums = np.append(0, np.cumsum((offsets[1:] - offsets[:-1])[where]))
                ids = gather(table, offsets, where)
                bounds = sums[np.append(0, ends)].tolist()
                for a in range(0, len(doc_ids), 256):
                    found = [ids[x:y].tobytes() for x, y in zip(bounds[a : a + 256], bounds[a + 1 : a + 257], strict=False)]
                    columns = [pa.array(doc_ids[a : a + 256], pa.int64()), pa.array(found, pa.binary())]
                    columns += [pa.array([shared.value.text(x) for x in found], pa.string())] if shared is not None else []
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets by place from a block's rows."""
    if not parts:
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    where, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(where, kind="stable")
    if not np.array_equal(where[order], np.arange(len(where))):
        raise RuntimeError("a block's words are incomplete: the input changed between two reads")
    offsets = np.append(0, np.cumsum(size, dtype=np.int64))
    return gather(data, offsets, order), np.append(0, np.cumsum(size[order], dtype=np.int64))


def _blocks_joined(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    added = vocabulary(path).added
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))  # the scan's own number, also below a union
    words = map_arrow(base, _word_rows(added, max(BUCKETS, _parts(docs))), _WORDS)
    coded = map_arrow(words.repartition(_parts(docs), "bucket").sortWithinPartitions("bucket"), _encode_words(path), _JOINED)
    placed = map_arrow(base, _doc_rows(added), _JOINED)
    return coded.unionByName(placed).repartition(_parts(docs), "block").sortWithinPartitions("block", "kind")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids) per row: ids as little-endian unsigned 32-bit integers, special strings as the tokenizer takes them."""
    return map_arrow(_blocks_joined(docs, path, id_col, text_col), _join_rows(), "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids, decoded) per row: ``encode``, and the id-to-piece join of ``decode`` in the same worker, so that a task needs one."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces(path))  # one entry per vocabulary id
    return map_arrow(_blocks_joined(docs, path, id_col, text_col), _join_rows(shared), "doc_id long, ids binary, decoded string")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Pieces:
    """The id-to-piece table as one byte string and offsets."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)

    def text(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        return gather(self.data, self.offsets, np.frombuffer(ids, dtype="<u4")).tobytes().decode("utf-8", "replace")


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path).pieces)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to "".  An id outside the vocabulary is an error."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*encoded.schema.fields]).add(out_col, StringType())
    at = encoded.columns.index(ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(path))  # one entry per vocabulary id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [table.text(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    return map_arrow(encoded, run, schema)


class LocalEncoder:
    """Encodes batches of texts by themselves, each distinct word once per block: for operators that need ids in place."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        block = Block(self.vocab.added)
        for some in _pieces(texts):
            block.add([texts[i] for i in some])
        words, docs = block.close()
        ids = self.vocab.encode(words)
        offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
        flat = np.fromiter((i for x in ids for i in x), dtype="<u4", count=int(offsets[-1]))
        return [gather(flat, offsets, d) for d in docs]
