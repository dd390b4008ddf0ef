"""Near-duplicate classes: consistent weighted sampling of TF-IDF word shingles, banded, verified by weighted Jaccard.

Texts are words of letters and digits, lower-cased in A-Z; a shingle is five consecutive words (a shorter text is one
shingle). A shingle's weight is its count in the text times a power of its inverse document frequency, which is counted
for every shingle over all documents.

* Documents go to chunks. A chunk asks, once for each of its different shingles, in how many documents it occurs; the
  askings meet in blocks of shingle hashes, and each block's answers go back to the chunks. Inside a block 40 bits of a
  hash tell shingles apart, so one in a million is taken for another one too, however large the corpus.
* A chunk then draws the signatures of its documents. Band keys make buckets; buckets of equal members are one bucket.
* The most central member of a bucket is compared with all others, which is a row a member. Members that are not linked
  with it are open; an open member is then compared with all members of its bucket, in blocks. So two members of a
  bucket are both linked with its central member, or have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.llm.store import dropped, small_side, stored
from spreadloom.llm.textscan import Words, mix, steps


@dataclass(frozen=True)
class Settings:
    """``width`` words a shingle; ``similarity`` from which texts are near duplicates; ``bands`` of ``rows`` samples.

    ``power`` is that of the inverse document frequency. At 1 (plain TF-IDF) what copies share would weigh little just
    because they are many, and large groups of copies would fall apart; at a quarter a shingle of a thousandth of a
    million documents weighs 0.85 of one that occurs once, and one in a third of them 0.54.

    ``chunk_bytes`` of text are one chunk, ``block_hashes`` askings one block: what a task holds. At 100 TB take 64 MB and
    16 million (1 GB a task), so that what a chunk sends to a block stays more than a few shingles.
    """

    width: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    power: float = 0.25
    chunk_bytes: int = 4 << 20
    block_hashes: int = 1 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


#: Shingles of the open members and of the members of a crowded bucket that a task compares at a time.
OPEN_BLOCK, MEMBER_BLOCK = 1 << 15, 1 << 17
#: In how many parts the members of a bucket look up how many blocks it has.
SALTS = 16
#: Shingles whose samples are drawn at a time, and how far a similarity may be below the threshold by rounding.
SLICE, ROUNDING = 1 << 14, 1e-6

_grid = np.linspace(0, 40, 400_001)
_quantiles = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + _grid) * np.exp(-_grid), _grid)
#: Quantiles of the Gamma(2, 1) distribution that consistent weighted sampling draws from, and their logarithms.
GAMMA, LOG_GAMMA = _quantiles.astype(np.float32), np.log(_quantiles).astype(np.float32)
_SEEDS = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIXTEEN = np.uint64(0xFFFF)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


def _by_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by row, then hash."""
    order = np.argsort(h)
    small = row[order].astype(np.uint16) if len(row) and row.max() < 1 << 16 else row[order]
    return order[np.argsort(small, kind="stable")]


def shingles(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the different shingles of each text, by row and hash."""
    out = []
    for a, buf, offs in steps(col):
        w = Words(buf, offs, "alnum")
        at, h = w.windows(w.hashes(), width, short=True)
        row = w.rows_of(at)
        order = _by_row(row, h)
        row, h = row[order], h[order]
        first = _firsts(row, h)
        out.append((row[first] + a, h[first], np.diff(np.append(first, len(h)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))


def idf(df: np.ndarray, n_docs: int, power: float) -> np.ndarray:
    """The power of the inverse document frequency, over that of a shingle that occurs in one document."""
    return ((np.log((2 + n_docs) / (1 + df)) / np.log((2 + n_docs) / 2)) ** power).astype(np.float32)


# ---- signatures -----------------------------------------------------------------------------------------------------
def _draw(h: np.ndarray, log_w: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each (shingle, weight) the improved consistent weighted sampling's ln a and step t."""
    x = mix(h ^ seed)
    r = GAMMA[(x >> np.uint64(48)).astype(np.int64)]
    beta = ((x & _SIXTEEN).astype(np.float32) + np.float32(0.5)) / np.float32(65536)
    t = np.floor(log_w / r + beta)
    return LOG_GAMMA[((x >> np.uint64(32)) & _SIXTEEN).astype(np.int64)] + r * (beta - t - np.float32(1)), t


def signatures(starts: np.ndarray, h: np.ndarray, weight: np.ndarray, n_samples: int) -> np.ndarray:
    """``n_samples`` of each text; ``starts`` tells where a text's shingles begin."""
    ends = np.append(starts[1:], len(h))
    log_w, out = np.log(weight), np.empty((len(starts), n_samples), np.uint64)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        own = slice(starts[a], ends[z - 1])
        hh, lw, begin, n = h[own], log_w[own], starts[a:z] - starts[a], ends[a:z] - starts[a:z]
        for k in range(n_samples):
            ln_a, t = _draw(hh, lw, _SEEDS[k])
            at = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, begin), n))
            text = np.searchsorted(begin, at, "right") - 1
            out[a + text[::-1], k] = mix(hh[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[::-1]
        a = z
    return out


def bands(samples: np.ndarray, s: Settings) -> np.ndarray:
    """One key for each band of each text's samples."""
    keys = np.zeros((len(samples), s.bands), np.uint64)
    for j in range(s.rows):
        keys = mix(keys * np.uint64(3) + samples[:, j :: s.rows])
    return mix(keys + np.arange(s.bands, dtype=np.uint64) * _SEEDS[200])


def _binary(data: np.ndarray, ends: np.ndarray, size: int, given: np.ndarray) -> pa.Array:
    """A binary column whose rows end at ``ends`` (in values of ``size`` bytes); rows not ``given`` are null."""
    offs = np.concatenate([[0], ends * size]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [pa.py_buffer(np.packbits(given, bitorder="little").tobytes()), pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])


def _packed(n: np.ndarray) -> bytes:
    """Numbers of which most are small: a byte each, and four more for those over 254."""
    large = n > 254
    return np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype("<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", (len(data) - n) // 4, n)
    return out


def _steps(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers by the steps between them, in four bytes where all steps are that short."""
    d = np.diff(values, prepend=np.uint64(0))
    return (d.astype("<u4") if not len(d) or d.max() < 1 << 32 else d.astype("<u8")).tobytes()


def _from_steps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u8"), dtype=np.uint64)


def signed(rows: DataFrame, s: Settings) -> DataFrame:
    """did, c1, c2 (what the words of a text hash to; null without words), k0.. (band keys), size, hashes and weights of
    its shingles (once for equal rows; weights are left empty where all are 1), for (did, text) rows, as a stored table.

    Document frequencies count rows, so every row asks and is counted, whatever its text. The answers are stored before
    the texts are dealt to their chunks again: what was asked has gone from the disks by then.
    """
    n_docs, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_chunks = max(1, (n_bytes or 0) // s.chunk_bytes)
    bits = max(0, ((n_bytes or 0) // 6 // s.block_hashes).bit_length())
    texts = rows.select(F.pmod(F.xxhash64("did"), F.lit(n_chunks)).cast("int").alias("chunk"), "did", "text")

    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, h, _ = shingles(table["text"].combine_chunks(), s.width)
        h, n = np.unique(h, return_counts=True)
        cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
        cuts = np.append(cuts, len(h))
        some, rest = np.flatnonzero(np.diff(cuts)), (h << np.uint64(bits)) >> np.uint64(24)
        part = lambda f, x: pa.array([f(x[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())
        return pa.table({"block": pa.array(some, pa.int32()), "chunk": pa.array(np.full(len(some), chunk), pa.int32()), "size": pa.array(np.diff(cuts)[some], pa.int32()), "h": part(_steps, rest), "n": part(_packed, n)})

    def answer(table: pa.Table) -> pa.Table:
        size = table["size"].to_pylist()
        h, n = (np.concatenate([f(x.as_py(), k) for x, k in zip(table[c], size, strict=True)]) for c, f in (("h", _from_steps), ("n", _unpacked)))
        order = np.argsort(h)
        first = _firsts(h[order])
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(h))))
        cuts = np.cumsum([0, *size])
        return pa.table({"chunk": table["chunk"], "block": table["block"], "size": table["size"], "df": pa.array([_packed(df[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def sign(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, h, count = shingles(texts["text"].combine_chunks(), s.width)
        by_block = np.argsort(answers["block"].to_numpy())
        told = [_unpacked(answers["df"][k].as_py(), answers["size"][k].as_py()) for k in by_block.tolist()]
        df = np.concatenate(told) if told else np.empty(0, np.int64)
        values, of = np.unique(h, return_inverse=True)
        if len(values) != len(df):
            raise ValueError("a chunk's answers do not fit what it asked")
        weight = count * idf(df, n_docs, s.power)[of]
        weight = weight.astype(np.float32)
        some, starts = np.unique(row, return_index=True)
        made = bands(signatures(starts, h, weight, s.samples), s).view(np.int64)
        own = count.astype(np.uint64)
        c = [np.add.reduceat(mix(h ^ _SEEDS[k]) * own, starts).view(np.int64) if len(some) else np.empty(0, np.int64) for k in (210, 211)]
        n = texts.num_rows
        did = texts["did"].combine_chunks().to_numpy()
        given = np.zeros(n, bool)
        given[some] = True

        def spread(x: np.ndarray) -> pa.Array:
            full = np.zeros(n, x.dtype)
            full[some] = x
            return pa.array(full, mask=~given)

        order = np.lexsort((c[1], c[0], did[some]))
        once = np.zeros(n, bool)
        once[some[order[_firsts(did[some][order], c[0][order], c[1][order])]]] = True
        size = np.zeros(n, np.int64)
        size[some] = np.diff(np.append(starts, len(h)))
        sent = once[row]
        held = np.ascontiguousarray(h[sent].view(np.uint8).reshape(-1, 8)[:, 3:])
        plain = np.ones(n, bool)
        plain[row[weight != 1]] = False
        ends = lambda flags: np.cumsum(np.where(flags, size, 0))
        return pa.table({
            "did": texts["did"], "c1": spread(c[0]), "c2": spread(c[1]), **{f"k{j}": spread(made[:, j]) for j in range(s.bands)}, "size": spread(size[some]),
            "hashes": _binary(held, ends(once), 5, once), "weights": _binary(weight[sent & ~plain[row]], ends(once & ~plain), 4, once),
        })

    asked = texts.groupBy("chunk").applyInArrow(ask, "block int, chunk int, size int, h binary, n binary")
    answers = stored(asked.groupBy("block").applyInArrow(answer, "chunk int, block int, size int, df binary"), "near-answers")
    schema = "did long, c1 long, c2 long, " + ", ".join(f"k{j} long" for j in range(s.bands)) + ", size long, hashes binary, weights binary"
    made = stored(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sign, schema), "near-signed")
    dropped(answers)
    return made


# ---- candidates and verification ------------------------------------------------------------------------------------
def _held(hashes: pa.ChunkedArray | pa.Array, weights: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the shingle sets of some rows."""
    size = np.array([len(x.as_buffer()) // 5 for x in hashes], np.int64)
    h = np.zeros((int(size.sum()), 8), np.uint8)
    h[:, 3:] = np.frombuffer(b"".join(x.as_buffer() for x in hashes), np.uint8).reshape(-1, 5)
    row = np.repeat(np.arange(len(size)), size)
    w = np.ones(len(row))
    own = np.array([len(x.as_buffer()) > 0 for x in weights], bool)
    w[own[row]] = np.frombuffer(b"".join(x.as_buffer() for x in weights), np.float32)
    return row, h.reshape(-1).view(np.uint64), w


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the weighted Jaccard similarity of their ``sets`` (did, hashes, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sides = [_held(part.column(2), part.column(3)), _held(part.column(4), part.column(5))]
                row, h, w = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = _by_row(row, h)
                row, h, w = row[order], h[order], w[order]
                total = np.bincount(row, w, part.num_rows)
                same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
                both = np.bincount(row[same], np.minimum(w[same], w[same + 1]), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both / np.maximum(total - both, 1e-12))], ["a", "b", "similarity"])

    side = lambda x: sets.select(F.col("did").alias(x), F.col("hashes").alias(f"h{x}"), F.col("weights").alias(f"w{x}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a long, b long, similarity double")


def _forest(rep: np.ndarray, leads: np.ndarray, row: np.ndarray, h: np.ndarray, w: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join what all pairs of an open member (``leads``) and another one at or over the
    threshold join: each such pair is compared, and of those that close a ring none is given."""
    n = len(rep)
    total = np.bincount(row, w, n)
    place = np.empty(n, np.int64)
    order = np.argsort(total, kind="stable")
    place[order] = np.arange(n)
    rep, leads, total = rep[order], leads[order], total[order]
    by = np.argsort(place[row], kind="stable")
    row, w = place[row][by], w[by]
    _, word = np.unique(h[by], return_inverse=True)
    at = np.searchsorted(row, np.arange(n + 1))
    own, label, out = np.zeros(int(word.max()) + 1 if len(word) else 0), np.arange(n), []
    for x in np.flatnonzero(leads).tolist():
        lo, hi = np.searchsorted(total, [total[x] * similarity * (1 - 1e-6), total[x] / similarity * (1 + 1e-6)])
        hi = min(int(hi) + 1, n)
        mine = word[at[x] : at[x + 1]]
        own[mine] = w[at[x] : at[x + 1]]
        both = np.add.reduceat(np.minimum(w[at[lo] : at[hi]], own[word[at[lo] : at[hi]]]), at[lo:hi] - at[lo])
        own[mine] = 0
        like = both / np.maximum(total[x] + total[lo:hi] - both, 1e-12)
        near = lo + np.flatnonzero(like >= similarity - ROUNDING)
        near = near[label[near] != label[x]]
        for y in near[np.unique(label[near], return_index=True)[1]].tolist():
            if rep[x] != rep[y]:
                out.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y])), float(like[y - lo])))
            label[label == label[y]] = label[x]
    return out


def _crowded(is_open: DataFrame, members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links among the members (key, rep, size) of buckets, from comparing each one in ``is_open`` with all of its bucket.
    Buckets without open members are passed over.

    Blocks of open members meet blocks of members, bounded by their shingles, so no task holds a bucket; a pair makes no
    row unless it is a link that joins two parts of its blocks.
    """
    blocks = lambda df, name, room: df.groupBy("key").agg(F.ceil(F.sum("size") / room).cast("int").alias(name))
    counts = blocks(is_open, "na", OPEN_BLOCK).join(blocks(members, "nb", MEMBER_BLOCK), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    deal = lambda n, k: F.pmod(F.xxhash64("rep", F.lit(k)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(SALTS)).cast("int"))
    marked = salted.join(counts, ["key", "salt"]).drop("salt").join(is_open.select("key", "rep", F.lit(True).alias("leads")), ["key", "rep"], "left")
    others = marked.select("key", "rep", deal("nb", 2).alias("b"), every("na").alias("a"), F.col("leads").isNotNull().alias("leads"), deal("na", 1).alias("home"))
    others = others.select("key", "a", "b", "rep", (F.col("leads") & (F.col("home") == F.col("a"))).alias("leads"))
    # An open member meets the blocks of members that it is not itself dealt to.
    leads = marked.where("leads").select("key", "rep", deal("na", 1).alias("a"), every("nb").alias("b"), deal("nb", 2).alias("home")).where("b <> home")
    rows = others.unionByName(leads.select("key", "a", "b", "rep", F.lit(True).alias("leads")))
    rows = rows.join(sets.withColumnRenamed("did", "rep"), "rep").select("key", "a", "b", "rep", "leads", "hashes", "weights")

    def run(table: pa.Table) -> pa.Table:
        row, h, w = _held(table["hashes"], table["weights"])
        links = _forest(table["rep"].to_numpy(), table["leads"].to_numpy(), row, h, w, s.similarity)
        return pa.table(dict(zip(["a", "b", "similarity"], ([x[k] for x in links] for k in range(3)), strict=True)), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())]))

    return rows.groupBy("key", "a", "b").applyInArrow(run, "a long, b long, similarity double")


def links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Verified links (a, b, similarity) that join all near duplicates among the members (key, n, rep, size) of buckets."""
    central = members.groupBy("rep").agg(F.round(F.sum(F.log2("n")), 6).alias("central"))
    lead = members.join(central, "rep").groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("top"))
    asked = stored(members.join(lead.select("key", (-F.col("top.minus")).alias("lead")), "key").where("lead <> rep").select("key", "n", "rep", "size", F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")), "near-asked")
    near = stored(similarities(asked.select("a", "b").distinct(), sets).where(F.col("similarity") >= s.similarity - ROUNDING), "near-led")
    is_open = stored(asked.where("n > 2").join(near.select("a", "b"), ["a", "b"], "left_anti").select("key", "rep", "size"), "near-open")
    found = stored(near.unionByName(_crowded(is_open, members.select("key", "rep", "size"), sets, s)).dropDuplicates(["a", "b"]), "near-links")
    dropped(asked, near, is_open)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): label is the least node that is linked with it, however far."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        over = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = labels.join(over, "node", "left").join(hop, "label", "left").select("node", F.least("label", "seen", "next").alias("new"), F.col("label").alias("old"))
        step = stored(step, "near-labels")
        dropped(labels)
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> old").isEmpty():
            dropped(both)
            return labels
        labels.table_path = step.table_path


def buckets(texts: DataFrame, s: Settings) -> DataFrame:
    """key, n, rep, c1 and size of the members of buckets with several texts; buckets of equal members are one."""
    keyed = texts.select("rep", "size", "c1", F.xxhash64("c1", "c2").alias("f"), F.explode(F.array(*[f"k{j}" for j in range(s.bands)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("f").alias("f1"), F.bit_xor(F.xxhash64("f", F.lit(1))).alias("f2")).where("n > 1")
    return keyed.join(sizes.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key", "n"), "key").select("key", "n", "rep", "c1", "size")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, class_id, n_links, kept for each row of ``docs``: near duplicates share a class.

    class_id is the smallest doc_id of the class, and that document is kept. n_links counts the other rows with the same
    words plus the links verified between different texts (enough of them to join the class). A null text, or one
    without words, is a class of its own. A row goes by its own text; different texts whose smallest doc_id is the same
    count as one document, near to whatever any of them is near. A null doc_id is a document of its own class that is
    kept and not counted. Ties go to the smaller doc_id, and an empty table gives an empty one. Other columns are left out.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("did"), "text")
    rows = ids.where("did is not null")
    made = signed(rows, s)
    keys = [f"k{j}" for j in range(s.bands)]
    texts = made.where("c1 is not null").groupBy("c1", "c2").agg(F.min("did").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), *[F.min(k).alias(k) for k in keys])
    texts = stored(texts, "near-texts")
    members = stored(buckets(texts, s), "near-members")
    wanted = stored(members.select(F.col("rep").alias("did"), "c1").distinct(), "near-wanted")
    sets = made.where("hashes is not null").select("did", "c1", "hashes", "weights").join(small_side(wanted), ["did", "c1"], "left_semi")
    sets = stored(sets.select("did", "hashes", "weights"), "near-sets")
    found = links(members, sets, s)
    label = components(found).withColumnRenamed("node", "rep")
    per = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("own"))
    named = texts.join(label, "rep", "left").join(per, "rep", "left")
    named = named.select("c1", "c2", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("own", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(named.where("n_links > 0"), "near-named")
    dropped(members, wanted, sets, found, texts)
    out = made.select(F.col("did").alias("doc_id"), "c1", "c2").join(named, ["c1", "c2"], "left")
    out = out.unionByName(ids.where("did is null").select(F.col("did").alias("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with one document of each class of near duplicates, all columns kept; a doc_id goes if no row of it is kept."""
    gone = stored(classes(docs, s).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "near-gone")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
