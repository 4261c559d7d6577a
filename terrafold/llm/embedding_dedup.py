"""Embedding near-dedup: an HNSW graph per shard, every shard queried, cosines verified, components united."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, small
from .components import components
from .hnsw import BLOCK, Graph, Union

THRESHOLD = 0.93
#: Distinct vectors in a shard, about.
SHARD = 8192
#: First beam; it doubles until every link of the audited queries is found.
EF = 48
#: Queries of each pair of shards that are audited against brute force, and the share of their links to be found.
AUDIT, RECALL = 128, 1.0
#: A query whose beam is full of links gets a wider one up to a shard's vectors divided by this; beyond, it is compared.
WIDE = 8
#: A beam is full if one in so many of its vectors is a link: among so many, others may have been missed.
DENSE = 2
#: Beam results this much below the threshold are verified in double precision too.
MARGIN = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links(graph: Graph, exact: np.ndarray, q: np.ndarray, threshold: float, own: bool = False):
    """Yields (query rows, graph rows) of all pairs of at least this cosine, for blocks of the queries q (unit, double).

    Every query is searched in the graph, whatever the shard's size. The beam widens until an audited sample misses no
    link. Should a beam of WIDE times the first, and of the shard divided by WIDE, or of the whole shard, still miss one,
    its vectors lie too dense for a graph, and all is compared. A query whose beam is full of links may have more than it
    holds: it is searched again with a wider one while that is cheaper than comparing it with the shard, and then
    compared, so that no link of a dense group is lost.
    """
    n, low = len(exact), threshold - MARGIN
    # The graph's own vectors are searched from themselves too.
    look = lambda rows, ef: graph.search(q[rows].astype(np.float32), ef, *([rows] if own else []))
    sample = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
    truth = (q[sample] @ exact.T) >= low
    ef, sound = min(EF, n), False
    while not sound:
        ids, sims = look(sample, ef)
        hit = (ids >= 0) & (sims >= low - MARGIN)
        found = np.zeros_like(truth)
        found[np.nonzero(hit)[0], ids[hit]] = True
        full = (DENSE * hit.sum(1) >= ef) & (ef < n)  # these get a wider beam anyway
        sound = (found & truth)[~full].sum() >= RECALL * truth[~full].sum()
        if ef == n or WIDE * ef >= n and ef >= WIDE * EF:
            break
        ef = ef if sound else min(2 * ef, n)
    for at in range(0, len(q), BLOCK):
        rows, beam = np.arange(at, min(len(q), at + BLOCK)), ef
        while len(rows) and sound and (beam == ef or WIDE * beam < n):
            ids, sims = look(rows, beam)
            hit = (ids >= 0) & (sims >= low - MARGIN)
            full = (DENSE * hit.sum(1) >= beam) & (beam < n)
            a, k = np.nonzero(hit & ~full[:, None])
            b = ids[a, k]
            sure = np.einsum("kd,kd->k", q[rows[a]], exact[b]) >= threshold
            yield rows[a[sure]], b[sure]
            rows, beam = rows[full], 4 * beam
        if len(rows):
            a, b = np.nonzero((q[rows] @ exact.T) >= threshold)
            yield rows[a], b


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    x = np.stack(pdf["embedding"].to_list())
    graph = Graph(_unit(x).astype(np.float32))
    row = {"label": pdf["label"].iloc[0], "dim": x.shape[1], "shard": pdf["shard"].iloc[0], "ids": pdf["rep"].to_numpy(np.int64).tobytes(), "counts": pdf["copies"].to_numpy(np.int64).tobytes(), "vectors": x.astype(np.float64).tobytes()}
    row |= {"levels": graph.levels.astype(np.int8).tobytes(), "layers": [near.tobytes() for near in graph.near], "entry": int(graph.entry[0])}
    return pd.DataFrame([row])


def _query(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        unpack = lambda s: (np.frombuffer(r[f"ids_{s}"], np.int64), np.frombuffer(r[f"counts_{s}"], np.int64), _unit(np.frombuffer(r[f"vectors_{s}"], np.float64).reshape(-1, r["dim"])))
        (qi, qc, q), (gi, gc, g) = unpack("a"), unpack("b")
        graph = Graph.__new__(Graph)
        graph.unit, graph.levels, graph.entry = g.astype(np.float32), np.frombuffer(r["levels_b"], np.int8).astype(int), np.array([r["entry_b"]])
        graph.near = [np.frombuffer(b, np.int32).reshape(len(g), -1) for b in r["layers_b"]]
        same, total = r["shard_a"] == r["shard_b"], np.zeros(len(q), np.int64)
        both = Union(len(q) if same else len(q) + len(g))
        for a, b in links(graph, g, q, threshold, same):
            if same:
                a, b = a[a != b], b[a != b]
            np.add.at(total, a, gc[b])
            both.join(a, b if same else b + len(q))
        ids = qi if same else np.concatenate([qi, gi])
        root = both.root(np.arange(len(ids)))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        moved = np.flatnonzero(least[root] != ids)
        some = np.flatnonzero(total)
        return pd.DataFrame({"id": np.concatenate([qi[some], ids[moved]]), "other": pd.array(np.concatenate([np.zeros(len(some), np.int64), least[root][moved]]), dtype="Int64"), "n": np.concatenate([total[some], np.zeros(len(moved), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links (other rows of its label with at least this cosine), component_id, kept.

    Rows whose vectors are equal become one, with a count. Each label's distinct vectors are dealt to shards of about
    SHARD by hash, a graph is built for each shard, and each pair of shards of a label is one task of bounded size: the
    vectors of one as queries against the graph of the other. Such a task counts links and unites what they link, and
    returns a number per vector and a tree, never pairs. Components of the trees unite across shards.

    Null labels, null or empty vectors, zero vectors, and null or non-finite components link with nothing and are kept.
    Vectors of different length never link. Null ids are taken as linked with nothing. Repeated rows count as rows.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("embedding"), F.col(label).cast("string").alias("label"))
    sound = F.size("embedding").__gt__(0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound, F.lit(False)))
    groups = rows.where("ok").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding"))
    groups = saved(groups, "distinct-vectors")
    sizes = small(saved(groups.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("shards")), "shards"))
    dealt = groups.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    schema = "label string, dim int, shard int, ids binary, counts binary, vectors binary, levels binary, layers array<binary>, entry int"
    graphs = saved(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, schema), "graphs")
    names = graphs.select("label", "dim", "shard")
    pairs = names.withColumnRenamed("shard", "shard_a").join(names.withColumnRenamed("shard", "shard_b"), ["label", "dim"])
    queries = graphs.select("label", "dim", F.col("shard").alias("shard_a"), F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"), F.col("vectors").alias("vectors_a"))
    indexes = graphs.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("shard", "ids", "counts", "vectors", "levels", "layers", "entry")])
    tasks = pairs.join(queries, ["label", "dim", "shard_a"]).join(indexes, ["label", "dim", "shard_b"])
    found = saved(tasks.groupBy("label", "dim", "shard_a", "shard_b").applyInPandas(_query(threshold), "id long, other long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    parts = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "rep", "component": "__c"})
    per_group = groups.join(counts, "rep", "left").join(parts, "rep", "left").select(F.col("label").alias("__l"), F.col("embedding").alias("__e"), F.lit(True).alias("__ok"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("__c", "rep").alias("component_id"))
    out = rows.join(per_group, (F.col("label") == F.col("__l")) & (F.col("embedding") == F.col("__e")) & (F.col("ok") == F.col("__ok")), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


ship(__name__)
