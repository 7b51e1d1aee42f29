"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Pieces come from a model file; a piece's '▁' stands for a space. A text with one space put before it falls into stretches,
each a run of spaces and the run of other bytes after it; no piece crosses from a stretch into the next. The lattice of a
stretch has a node at each byte and an edge for each piece that matches there; a character that is no piece by itself gets
edges of byte pieces. An edge's log-weight is ALPHA * -log(rank of the piece + RANK_SHIFT), by the pieces' order in the model.

Forward filtering sums the weights of all ways to each node, once for each distinct stretch that a process meets and for many
of them at once, position by position. Backward sampling walks every stretch of every text from its end, choosing an
edge by weight; the random numbers are hashes of the row's key, the place of the stretch in the text and the node, and a
node's weights are summed by themselves, so that a segmentation depends on nothing else. Stretches and pieces are found by hash and
told by their bytes. Decoding joins the pieces' bytes and takes off the first space.

No normalization is applied, and a literal '▁' in a text is encoded by byte pieces, so that every text decodes to itself.

Cases: null encodes to null; an empty text to no ids, which decode to the empty text; stretches of any length work, in memory
proportional to the longest text; repeated rows get equal ids; a null key counts as a key of its own; an empty table gives an
empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import table
from .stretches import Growing, Stretches

ALPHA, RANK_SHIFT = 0.5, 16.0
CHUNK, PART = 2 << 20, 1 << 18
#: Stretches a process remembers at most; beyond it it starts afresh.
MOST_KNOWN = 120_000
#: So few stretches that are still to be walked are walked one by one.
FEW = 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x20] = True


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """The model's pieces as bytes, looked up by length and hash."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, dtype=np.int64)
        ids, weights = [], np.full(size, -np.inf)
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.pieces[i] = bytes([int(name[3:5], 16)])
                self.byte_id[self.pieces[i][0]] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.pieces[i] = name.replace("▁", " ").encode()
                ids.append(i)
            weights[i] = -alpha * np.log((size if model.is_byte(i) else i) + RANK_SHIFT)
        self.sizes = np.array(list(map(len, self.pieces)), dtype=np.int64)
        self.starts = bt.bounds(self.sizes)
        self.flat = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.tables = {}  # by length: sorted hashes, ids, a filter by 16 bits of the hash
        kept = np.array(ids)
        self.weights = weights
        self.known = Stretches(MOST_KNOWN)
        self.forget()
        for n in np.unique(self.sizes[kept]):
            found = kept[self.sizes[kept] == n]
            at = np.arange(len(found)) * n
            hashes = bt.span_hasher(self.flat[bt.ragged(self.starts[found], np.full(len(found), n))])(at, at + n)
            order = np.argsort(hashes)
            screen = np.zeros(1 << 16, dtype=bool)
            screen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables[int(n)] = hashes[order], found[order], screen

    def edges(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last byte, length, id) of all edges of the stretches, by last byte and then by length."""
        hashed = bt.span_hasher(flat)
        room = np.arange(len(flat)) - np.repeat(starts, ends - starts) + 1  # bytes of the stretch up to here
        seen = []
        for n, (hashes, found, screen) in self.tables.items():
            at = np.flatnonzero(room >= n)
            own = hashed(at - n + 1, at + 1)
            able = np.flatnonzero(screen[(own >> np.uint64(48)).astype(np.int64)])
            at, own = at[able], own[able]
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == own)
            at, ids = at[hit], found[place[hit]]
            for k in range(n):
                same = flat[at - n + 1 + k] == self.flat[self.starts[ids] + k]
                if not same.all():
                    at, ids = at[same], ids[same]
            seen.append((at, np.full(len(at), n), ids))
        # characters that are no piece by themselves, from their first to their last byte
        head = np.flatnonzero((flat & 0xC0) != 0x80)
        size = np.diff(np.append(head, len(flat)))
        known = np.zeros(len(flat), dtype=bool)
        ends_at = np.repeat(head + size - 1, size)
        for at, n, _ in seen:
            known[(at - n + 1)[(ends_at[at - n + 1] == at)]] = True
        lost = bt.ragged(head[~known[head]], size[~known[head]])
        seen.append((lost, np.ones(len(lost), dtype=np.int64), self.byte_id[flat[lost]]))
        at, n, ids = (np.concatenate(x) for x in zip(*seen, strict=True))
        order = np.argsort(at * (int(self.sizes.max()) + 1) + n, kind="stable")
        return at[order], n[order], ids[order]

    def forward(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each edge its and its predecessors' share in the weight of all ways to the node after its last byte."""
        depth = at - np.repeat(starts, ends - starts)[at]
        order = np.lexsort((at, depth))
        total = np.full(int(ends[-1]) + 1 if len(ends) else 1, -np.inf)  # by last byte; the ways to a stretch's start weigh 0
        each = np.full(len(at), -np.inf)
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
        for t in range(len(cuts) - 1):
            rows = order[cuts[t] : cuts[t + 1]]
            if not len(rows):
                continue
            nodes = at[rows]
            new = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
            counts = np.diff(np.append(new, len(rows)))
            w = self.weights[ids[rows]] + np.where(n[rows] == t + 1, 0.0, total[nodes - n[rows]])
            high = np.maximum.reduceat(w, new)
            part = np.exp(w - np.repeat(np.where(high > -np.inf, high, 0.0), counts))
            with np.errstate(divide="ignore"):
                total[nodes[new]] = high + np.log(np.add.reduceat(part, new))
            each[rows] = w
        with np.errstate(invalid="ignore"):
            each = np.where(each > -np.inf, np.exp(each - total[at]), 0.0)
        shares, counts = np.zeros(len(at), dtype=np.float32), np.bincount(at)
        first, run = bt.bounds(counts)[:-1], np.zeros(len(counts))
        for r in range(int(counts.max(initial=0))):  # a node has at most as many edges as there are lengths of pieces
            able = np.flatnonzero(counts > r)
            run[able] += each[first[able] + r]
            shares[first[able] + r] = run[able]
        return shares

    def forget(self) -> None:
        self.known.forget()
        self.slots = Growing(np.int64)  # by number of the stretch: the first node
        self.node_edges = Growing(np.int64)  # of each node's first edge, and the end
        self.node_edges.add(np.zeros(1, dtype=np.int64))
        self.edge_share, self.edge_size, self.edge_id = Growing(np.float32), Growing(np.uint8), Growing(np.int32)

    def learn(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """flat: new stretches one after another."""
        to = np.cumsum(sizes)
        self.slots.add(self.node_edges.size - 1 + to - sizes)
        i = 0
        while i < len(sizes):
            low = int(to[i] - sizes[i])
            j = max(i + 1, int(np.searchsorted(to, low + PART, side="right")))
            starts, ends = to[i:j] - sizes[i:j] - low, to[i:j] - low
            at, n, ids = self.edges(flat[low : low + int(ends[-1])], starts, ends)
            self.edge_share.add(self.forward(starts, ends, at, n, ids))
            self.node_edges.add(self.edge_size.size + np.cumsum(np.bincount(at, minlength=int(ends[-1]))))
            self.edge_size.add(n.astype(np.uint8))
            self.edge_id.add(ids.astype(np.int32))
            i = j

    def chosen(self, nodes: np.ndarray, seeds: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The edge drawn at each node, which stands left bytes after its stretch's start."""
        draw = (bt.mix(seeds + left.astype(np.uint64), 13) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        ends, share = self.node_edges(), self.edge_share()
        edge, last = ends[nodes], ends[nodes + 1] - 1
        more = np.flatnonzero((share[edge] <= draw) & (edge < last))
        while len(more):
            edge[more] += 1
            more = more[(share[edge[more]] <= draw[more]) & (edge[more] < last[more])]
        return edge

    def encode(self, texts: pa.Array, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunk by chunk: the rows' ids one after another, and how many each row has."""
        for row, end, flat, offsets in bt.chunks(texts, CHUNK):
            n = end - row
            filled = np.diff(offsets) > 0
            # a space before each text that isn't empty
            spaced = np.insert(flat, offsets[:-1][filled], 0x20)
            edges = offsets + np.concatenate(([0], np.cumsum(filled)))
            if not len(spaced):
                yield np.zeros(0, dtype=np.int64), np.zeros(n, dtype=np.int64)
                continue
            space = _SPACE[spaced]
            cut = np.zeros(len(spaced), dtype=bool)
            cut[1:] = space[1:] & ~space[:-1]
            cut[edges[:-1][filled]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(spaced))
            rows = np.searchsorted(starts, edges)
            if self.known.full():
                self.forget()
            numbers, new = self.known.number(spaced, starts, ends)
            if len(new):
                sizes = (ends - starts)[new]
                self.learn(spaced[bt.ragged(starts[new], sizes)], sizes)
            base = self.slots()[numbers]
            owner = np.repeat(np.arange(n), np.diff(rows))
            seed = bt.mix(keys[row:end][owner] + bt.mix((np.arange(len(starts)) - rows[:-1][owner]).astype(np.uint64), 11), 12)
            left = ends - starts
            alive = np.arange(len(starts))
            seen_at, seen_id = [], []
            size, name = self.edge_size(), self.edge_id()
            while len(alive) > FEW:
                edge = self.chosen(base[alive] + left[alive] - 1, seed[alive], left[alive])
                seen_at.append(starts[alive] + left[alive] - 1)
                seen_id.append(name[edge])
                left[alive] -= size[edge]
                alive = alive[left[alive] > 0]
            for i in alive.tolist():  # long ones: an edge is drawn at every node, and the walk takes those that it meets
                n = int(left[i])
                edge = self.chosen(base[i] + np.arange(n), np.broadcast_to(seed[i], n), np.arange(1, n + 1))
                back, met = size[edge].tolist(), []
                while n:
                    met.append(n - 1)
                    n -= back[n - 1]
                seen_at.append(starts[i] + np.array(met))
                seen_id.append(name[edge[met]])
            at, picked = np.concatenate(seen_at), np.concatenate(seen_id)
            order = np.argsort(at, kind="stable")
            yield picked[order].astype(np.int64), np.diff(np.searchsorted(at[order], edges))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The rows' texts as bytes."""
        flat = self.flat[bt.ragged(self.starts[ids], self.sizes[ids])]
        at = bt.bounds(self.sizes[ids])[bt.bounds(counts)]
        return [flat[a + 1 : b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    return Lattice(path, alpha)


def encode_udf(path: str, alpha: float = ALPHA):
    """A UDF from text and key (a 64-bit integer) to ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array, keys: pa.Array) -> pa.Array:
        parts, counts = [], []
        for ids, count in lattice(path, alpha).encode(texts, keys.to_numpy(zero_copy_only=False).view(np.uint64)):
            parts.append(ids.astype(np.int32))
            counts.append(count)
        at = pa.array(bt.bounds(np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)))

    return encoded


def decode_udf(path: str):
    """A UDF from ids to text."""

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(ids), 500):
            part = ids.slice(at, 500)
            counts = np.diff(part.offsets.to_numpy()).astype(np.int64)
            values = part.flatten().to_numpy().astype(np.int64)
            out += [x.decode() for x in lattice(path).decode(values, counts)]
        return pa.array(out, pa.string())

    return decoded


def encode(docs: DataFrame, path: str, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, text, ids) of each row of docs, which has doc_id and text."""
    ids = encode_udf(path, alpha)(F.coalesce("text", F.lit("")), F.xxhash64("doc_id"))
    return docs.select("doc_id", "text", ids.alias("ids")).withColumn("ids", F.when(F.col("text").isNotNull(), F.col("ids")))


def round_trip(docs: DataFrame, path: str, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of each row of docs: the ids' number and checksum (as little-endian unsigned
    32-bit integers), and whether they decode to the text. Encodes and decodes chunk by chunk in one pass, and keeps no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, alpha)
        for batch in batches:
            texts, keys = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            row = 0
            for ids, counts in model.encode(texts, keys):
                n = len(counts)
                at = bt.bounds(counts)
                flat = ids.astype("<u4")
                sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                same = [x == (t.as_py() or "").encode() for x, t in zip(model.decode(ids, counts), texts.slice(row, n), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "lossless"])
                row += n

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), model_path())
