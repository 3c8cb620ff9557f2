"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is the weighted set of its shingles of ``width`` words (a text of
fewer words is one shingle).  Weight = occurrences x idf, idf = 1 + ln(1 + N/df) /
ln(1 + N) (between 1 and 2), df over all documents.  Samples follow the improved consistent
weighted sampling scheme (Ioffe, 2010): for shingle weight S, with r, c ~ Gamma(2, 1) and
b ~ U(0, 1) drawn from the shingle's hash, t = floor(ln S / r + b), and the
shingle of least ln c - r (t - b + 1) is the sample; two documents agree in a sample with the
probability of their weighted Jaccard similarity.  ``rows`` samples make a band key.

Copies (equal word sequences) are one node.  A document whose shingles with df >= 2 weigh less
than ``threshold`` of the whole can't reach it with any other, so it is left out of the
banding (nothing is lost).  Members of a band are compared with its most central node. Members of bands that
then still hold several components are settled exactly: pairs of two components that can reach ``threshold`` meet on their rarest shingles, all others are
excluded by their weights.  Each comparison is the exact weighted
Jaccard similarity of the whole shingle sets; a class is a component of the similar pairs.

Cases: a document without words (null, empty) is its own class; rows with equal words are one class; a
null doc_id takes part and is never the name of a class that has another id;
equal minima are settled by the smallest doc_id; different texts under one doc_id (or none) are rows of their own, so classes
may share a name, and each keeps one row: the least by doc_id, then text hash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hygeia.llm import exchange as X
from hygeia.llm import words as K
from hygeia.llm.common import Scratch, block_count, range_block, range_bounds
from hygeia.llm.graph import components

U = np.uint64
_SIGNED = "chunk int, doc_id bigint, text_key bigint, node binary, bands array<bigint>, payload binary"
_DRAWS: dict = {}
#: Ids of a list that may be sent to every task (16 bytes each).
SHORT_LIST = 100_000
#: Entries of one shingle that meet in a task: more are dealt to blocks, each against each.
MEET = 512
_ENTRY = "shingle bigint, node binary, root binary, whole double, rest double, light boolean"


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65,536 levels, and of its logarithm."""
    if "g" not in _DRAWS:
        x = np.concatenate([np.geomspace(1e-6, 1, 60_000), np.linspace(1, 30, 120_000)[1:]])
        g = np.interp((np.arange(65_536) + 0.5) / 65_536, 1 - (1 + x) * np.exp(-x), x)
        _DRAWS["g"] = (g, np.log(g))
    return _DRAWS["g"]


def shingles(t: pa.Table, width: int):
    """Words per text, a 128-bit hash of the word sequence, and (text, hash) of every shingle."""
    buf, offs = K.flat(t["text"])
    s, e, first = K.words(buf, offs)
    h = K.span_hash(buf, s, e)
    n = np.diff(first)
    at, w = K.windows(h, first, width)
    doc = K.owner(first, at)
    short = np.flatnonzero((n > 0) & (n < width))
    both = []
    for seed in (3, 5):
        x = K.mix(h ^ U(seed)) * K.powers(len(h), K.BASE + 2 * seed) if len(h) else h
        c = np.zeros(len(h) + 1, U)
        np.cumsum(x, out=c[1:])
        inv = K.powers(len(h) + 1, pow(K.BASE + 2 * seed, -1, 2**64))
        both.append(K.mix((c[first[1:]] - c[first[:-1]]) * inv[first[:-1]] + n.astype(U) * U(K.GOLD)))
    if len(short):
        doc, w = np.concatenate([doc, short]), np.concatenate([w, K.mix(both[0][short] + U(1))])
    return n, both, doc, w


def document_counts(doc: np.ndarray, h: np.ndarray):
    """Sorted distinct hashes with the number of documents, and the distinct (document, hash, times) triples by document."""
    o, s = K.order_of(h)
    d = doc[o]
    if not len(s):
        z = np.zeros(0, np.int64)
        return s, z, z, z, z
    new_h = np.concatenate([[True], s[1:] != s[:-1]])
    swap = np.flatnonzero(~new_h[1:] & (d[1:] < d[:-1]))
    if len(swap):  # shingles of short texts stand behind the others: put documents in order inside a hash
        o = np.lexsort((doc, h))
        d = doc[o]
    new = new_h | np.concatenate([[True], d[1:] != d[:-1]])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(s)]]))
    which = (np.cumsum(new_h) - 1)[at]
    df = np.bincount(which)
    return s[new_h], df, d[at], which, times


def signature(doc_first: np.ndarray, h: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """(documents x samples) consistent weighted samples; the entries of document i start at doc_first[i]."""
    gamma, log_gamma = _draws()
    log_w = np.log(weight)
    seg = np.diff(np.concatenate([doc_first, [len(h)]]))
    out = np.empty((len(doc_first), samples), U)
    for k in range(samples):
        u = K.mix(h + U((k + 1) * K.GOLD & (2**64 - 1)))
        r = gamma[(u & U(0xFFFF)).astype(np.int64)]
        b = (u >> U(32)).astype(np.float64) * 2.0**-32
        t = np.floor(log_w / r + b)
        a = log_gamma[((u >> U(16)) & U(0xFFFF)).astype(np.int64)] - r * (t - b + 1)
        best = np.minimum.reduceat(a, doc_first)
        hit = np.flatnonzero(a == np.repeat(best, seg))
        own = np.searchsorted(doc_first, hit, "right") - 1
        hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]
        out[:, k] = K.mix(h[hit] ^ (t[hit].astype(np.int64).view(U) * U(K.GOLD)))
    return out


def _idf(df: np.ndarray, total: int) -> np.ndarray:
    return 1 + np.log1p(total / df) / np.log1p(max(total, 1))


def _pack(h: np.ndarray, times: np.ndarray, df: np.ndarray) -> bytes:
    parts = [X.squeeze_sorted(h), X.squeeze(times.astype(np.int64)), X.squeeze(df.astype(np.int64))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(b: bytes, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their weights and document frequencies."""
    parts, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i:i + 8], "little")
        parts.append(b[i + 8:i + 8 + n])
        i += 8 + n
    df = X.expand(parts[2], np.int64)
    return X.expand_sorted(parts[0]), X.expand(parts[1], np.int64) * _idf(df, total), df


def _unpack(b: bytes, total: int) -> tuple[np.ndarray, np.ndarray]:
    return _parts(b, total)[:2]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    common = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _compare(total: int):
    def rows(batches):
        last, right = None, None
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            sims = []
            for x, p, y in zip(c["payload"], c["pivot"], c["pivot_payload"]):
                if p != last:
                    last, right = p, _unpack(y, total)
                sims.append(weighted_jaccard(_unpack(x, total), right))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"),
                                              pa.array(sims, pa.float64())], names=["node", "pivot", "sim"])
    return rows


def _only(payloads: DataFrame, ids: DataFrame) -> DataFrame:
    """The payloads of the nodes in ``ids`` (column node, distinct). A short list of ids is sent to the payloads (its size
    is counted first); a long one is joined by shuffle."""
    short = ids.limit(SHORT_LIST + 1).count() <= SHORT_LIST
    return payloads.join(F.broadcast(ids) if short else ids, "node", "left_semi")


def _entries(total: int, threshold: float):
    """The shingles on which a node meets others, rarest first: those from which on at least ``threshold`` of its weight is left;
    light: enough is left for it to be the lighter one of a pair."""
    def rows(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = []
            for node, root, payload in zip(c["node"], c["root"], c["payload"]):
                h, w, df = _parts(payload, total)
                o = np.lexsort((h, df))
                h, w, df = h[o], w[o], df[o]
                rest = np.cumsum(w[::-1])[::-1]
                whole = float(rest[0])
                at = np.flatnonzero((df > 1) & (rest >= threshold * whole - 1e-9))
                out.append(pa.table({
                    "shingle": pa.array(h[at].view(np.int64)), "node": pa.array([node] * len(at), pa.binary()),
                    "root": pa.array([root] * len(at), pa.binary()), "whole": pa.array(np.full(len(at), whole)),
                    "rest": pa.array(rest[at]), "light": pa.array(rest[at] >= 2 * threshold / (1 + threshold) * whole - 1e-9)}))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches(max_chunksize=50_000)
    return rows


def _meetings(rooted: DataFrame, payloads: DataFrame, total: int, threshold: float, work: Scratch) -> DataFrame:
    """Distinct (node, pivot) of different roots, among them all that reach ``threshold``; rooted: node, root.

    Let a be the lighter one. Similarity t needs a common weight of t / (1 + t) of the sum of both, so at least
    2 t / (1 + t) of a and t of b, all of it at or after their first common shingle (by df, hash): there the pair meets.
    At a shingle, nodes of its most frequent root meet only those of other roots."""
    nodes = rooted.join(_only(payloads, rooted.select("node").distinct()), "node").select("node", "root", "payload")
    entry = work.table(nodes.mapInArrow(_entries(total, threshold), _ENTRY), "entries")
    per = entry.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    spread = (per.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("big"))
              .where("roots > 1").select("shingle", F.ceil(F.col("n") / MEET).cast("int").alias("blocks"), F.col("big.root").alias("big")))
    entry = work.table(entry.join(spread, "shingle").withColumn("main", F.col("root") == F.col("big")).drop("big"), "spread")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = entry.where("light").withColumn("i", own).withColumn("j", every).alias("a")
    right = entry.withColumn("j", own).withColumn("i", every).alias("b")
    can = [F.col("a.shingle") == F.col("b.shingle"), F.col("a.i") == F.col("b.i"), F.col("a.j") == F.col("b.j"),
           F.col("a.root") != F.col("b.root"),
           (F.col("a.whole") < F.col("b.whole")) | ((F.col("a.whole") == F.col("b.whole")) & (F.col("a.node") < F.col("b.node"))),
           F.col("b.whole") * threshold <= F.col("a.whole") + 1e-9,
           F.least("a.rest", "b.rest") >= threshold / (1 + threshold) * (F.col("a.whole") + F.col("b.whole")) - 1e-9]
    pair = [F.least("a.node", "b.node").alias("node"), F.greatest("a.node", "b.node").alias("pivot")]
    met = left.where("not main").join(right, can).select(*pair)
    return met.unionByName(left.where("main").join(right.where("not main"), can).select(*pair)).distinct()


def _merged(roots: DataFrame, new: DataFrame, work: Scratch, name: str) -> DataFrame:
    """``roots`` after the links ``new``: components of components, so only edges between two of them."""
    ends = (new.join(roots.select(F.col("node").alias("a"), F.col("root").alias("u")), "a", "left")
            .join(roots.select(F.col("node").alias("b"), F.col("root").alias("v")), "b", "left")
            .select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b")))
    merged = components(ends, Scratch(work.spark, "components")).select(F.col("node").alias("root"), F.col("root").alias("to"))
    fresh = merged.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return work.table(roots.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
                      .unionByName(fresh), name)


def _compared(pairs: DataFrame, payloads: DataFrame, total: int, work: Scratch, name: str) -> DataFrame:
    """(node, pivot, sim) of distinct (node, pivot): the exact similarity of each pair."""
    pairs = work.table(pairs, f"near_{name}")
    ids = pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct()
    of = _only(payloads, ids)
    other = of.select(F.col("node").alias("pivot"), F.col("payload").alias("pivot_payload"))
    both = pairs.join(of, "node").join(other, "pivot").select("node", "pivot", "payload", "pivot_payload")
    return work.table(both.mapInArrow(_compare(total), "node binary, pivot binary, sim double"), f"found_{name}")


def _link(banded: DataFrame, payloads: DataFrame, total: int, threshold: float, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links a, b of similar nodes; node, root of each component) from (node, band) and (node, payload).

    Every member of a band is compared with the band's most central node, the one whose bands have the most
    members: one pair a member, which joins most of a large group at once. Members of bands (of three or more) that
    then hold several components are settled by ``_meetings``. Components are worked out of the first links, and of
    the components that the second links join."""
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    member = work.table(banded.join(sizes, "band"), "member")
    score = member.groupBy("node").agg(F.sum("m").alias("score"))
    scored = work.table(member.join(score, "node").select("band", "node", "m", "score"), "scored")
    best = scored.groupBy("band").agg(F.max(F.struct("score", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))
    pair = [F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot")]
    found = _compared(scored.join(best, "band").where("node <> pivot").select(*pair).distinct(), payloads, total, work, "central")
    similar = [F.col("node").alias("a"), F.col("pivot").alias("b")]
    links = found.where(F.col("sim") >= threshold).select(*similar)
    roots = work.table(components(links, Scratch(work.spark, "components")), "roots")
    rooted = (scored.where("m > 2").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    parts = (rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high"))
    left = work.table(rooted.join(parts.select("band"), "band", "left_semi").select("node", "root").distinct(), "unsettled")
    if left.isEmpty():
        return links, roots
    met = _meetings(left, payloads, total, threshold, work).join(found.select("node", "pivot"), ["node", "pivot"], "left_anti")
    new = _compared(met, payloads, total, work, "met").where(F.col("sim") >= threshold).select(*similar)
    return (links, roots) if new.isEmpty() else (links.unionByName(new), _merged(roots, new, work, "roots_met"))


def near_classes(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links (compared texts
    found similar), kept (true for one row of each class)."""
    return _classes(docs, **params).select("doc_id", "class_id", "n_links", "kept")


def _classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 6,
             chunk_bytes: int = 8 << 20) -> DataFrame:
    """``near_classes`` with text_key (hash of the text) and wordless."""
    spark = docs.sparkSession
    work = Scratch(spark, "minhash")
    head = docs.agg(F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()
    total = head["rows"]
    chunks = buckets = block_count(spark, head["n"], chunk_bytes, 256 << 10)
    bounds = range_bounds(docs, "doc_id", chunks)
    dealt = docs.select(range_block("doc_id", bounds).cast("int").alias("chunk"), F.col("doc_id").cast("bigint"), "text",
                        F.xxhash64("text").alias("text_key"))

    def ask(t: pa.Table) -> pa.Table:
        _, _, doc, w = shingles(t, width)
        h, df, *_ = document_counts(doc, w)
        return X.questions(t["chunk"][0].as_py(), h, buckets, df)

    def sign(t: pa.Table, said: pa.Table) -> pa.Table:
        n, seq, doc, w = shingles(t, width)
        h, df, d, which, times = document_counts(doc, w)
        del doc, w
        df = df + X.read_count(said, buckets, h)
        o = np.argsort(d, kind="stable")  # by document, hashes ascending inside
        d, which, times = d[o], which[o], times[o]
        weight = times * _idf(df[which], total)
        size = len(n)
        whole = np.bincount(d, weight, size)
        shared = np.bincount(d, weight * (df[which] > 1), size)
        may = (n > 0) & (shared >= threshold * whole - 1e-9)
        first_copy = np.zeros(size, bool)
        node = np.stack(seq, 1)
        first_copy[np.unique(node, axis=0, return_index=True)[1]] = True
        may &= first_copy
        keep = may[d]
        d, hs, times, dfs, weight = d[keep], h[which[keep]], times[keep], df[which[keep]], weight[keep]
        ids = np.flatnonzero(may)
        start = np.searchsorted(d, ids)
        end = np.searchsorted(d, ids, "right")
        band_keys, payload = [None] * size, [None] * size
        if len(ids):
            sig = signature(start, hs, weight, bands * rows).reshape(len(ids), bands, rows)
            key = np.zeros((len(ids), bands), U) + (np.arange(bands, dtype=U) * U(K.GOLD))
            for k in range(rows):
                key = K.mix(key * U(K.BASE) + sig[:, :, k])
            key = key.view(np.int64)
            for j, i in enumerate(ids):
                band_keys[i] = key[j].tolist()
                a, b = start[j], end[j]
                payload[i] = _pack(hs[a:b], times[a:b], dfs[a:b])
        raw = np.ascontiguousarray(node).tobytes()
        return pa.table({
            "chunk": t["chunk"].combine_chunks(), "doc_id": t["doc_id"].combine_chunks(),
            "text_key": t["text_key"].combine_chunks(),
            "node": pa.array([raw[16 * i:16 * i + 16] if n[i] else None for i in range(size)], pa.binary()),
            "bands": pa.array(band_keys, pa.list_(pa.int64())), "payload": pa.array(payload, pa.binary())})

    answers = X.ask_all(dealt, ask, X.answer_count)
    signed = work.table(X.with_answers(dealt, answers, sign, _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes = signed.where("bands is not null")
    # a node may come from several chunks: one payload each
    payloads = work.table(nodes.select("node", "payload").dropDuplicates(["node"]), "payloads")
    links, roots = _link(nodes.select("node", F.explode("bands").alias("band")).distinct(), payloads, total, threshold, work)
    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")
    names = signed.where("node is not null").groupBy("node").agg(F.min(key).alias("least"))
    named = names.join(roots, "node", "left").join(degree, "node", "left")
    # the first row of each component; nodes without links name themselves
    comp = named.where("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    by_node = (named.join(comp, "root", "left")
               .select("node", F.coalesce("first", "least").alias("first"),
                       F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    none = F.col("node").isNull()
    return (signed.select("doc_id", "text_key", "node", "row").join(by_node, "node", "left")
            .select("doc_id", F.when(none, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), (none | (F.col("row") == F.col("first.row"))).alias("kept"),
                    "text_key", none.alias("wordless")))


def near_dedup(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest doc_id, then of the least text hash. Rows equal in
    both are one document (the first by the other columns), but for texts without words under a null doc_id."""
    keep = _classes(docs, **params).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "wordless").distinct()
    names = docs.columns
    key = F.xxhash64("text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key"))
    others = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    one = W.partitionBy("doc_id", "_key").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    copy = docs.join(keep, same).withColumn("_row", F.row_number().over(one)).where("_row = 1 or (doc_id is null and wordless)")
    return copy.select(*[F.col(f"`{c}`") for c in names])
