"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document's set holds its distinct five-word shingles. Its signature has COORDINATES
values, and the document is posted under each (coordinate, value) pair. Two documents
that agree in at least MATCHES coordinates are candidates, and every candidate is
confirmed on the full sets: linked if 100 * |A and B| >= 75 * |A or B|.

Prefix and skip merging: each document's postings are ordered by how rare the pair is.
Pairs met in one document only cannot collide and are dropped; a document with fewer than
MATCHES live pairs has no partner. Two documents with MATCHES common pairs share at least
one of their first (live - MATCHES + 1), so only that prefix is merged, and the rest of a
signature is compared only for pairs that met there. At similarity 0.75 the chance to
agree in fewer than 5 of 16 coordinates is 4e-5; more similar pairs are missed less.

Only components are asked for, so no group is expanded into its pairs: documents with
equal sets are one class from the start; then each bucket of the prefix index is compared
with one of its members, drawn anew each round, and buckets whose members lie in one
component drop out. After ROUNDS rounds the members outside a bucket's largest component
are compared with the whole bucket, in blocks, and one link per component is returned.
Thus every pair of candidates lies in one component or has been compared.

Defined cases: a null or empty text, or one of white space, has an empty set and no links;
fewer than five words make one shingle of the whole sequence; equal sets are linked;
rows with the same doc_id count as one document per distinct set; further columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.graph import components
from glyphflow.llm.kernels import Bytes, grams, mix, slices
from glyphflow.plans.staging import Workspace, broadcast_if_small

SHINGLE = 5
COORDINATES, MATCHES = 16, 5
PERCENT = 75
ROUNDS = 3
BLOCK = 1000
#: Buckets of up to so many members are compared by a plain join, larger ones in blocks.
SMALL = 32
_SEED = [(0x9E3779B97F4A7C15 * (2 * c + 1)) & (2**64 - 1) for c in range(COORDINATES)]
_ODD = [((0xD6E8FEB86659FD93 * (2 * c + 3)) | 1) & (2**64 - 1) for c in range(COORDINATES)]


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Bytes(col).words()
    h, first = words.hash, words.first
    rolled = grams(h, SHINGLE)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= SHINGLE:
            x = np.sort(rolled[lo : hi - SHINGLE + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        else:
            out.append(grams(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES keys for each set (zeros for empty ones); a key names coordinate and value."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for c in range(COORDINATES):
            least = np.minimum.reduceat((flat ^ np.uint64(_SEED[c])) * np.uint64(_ODD[c]), at)
            out[full, c] = mix(least + np.uint64(_SEED[c]))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column(1))
            keys = signatures(sets).view(np.int64)
            a = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in sets], np.uint64)
            b = np.array([mix(x).sum(dtype=np.uint64) if len(x) else 0 for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, COORDINATES), pa.int32()), pa.array(keys.ravel()))],
                ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column(1))
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["id", "shingles"])


def _linked(inter, a, b):
    return 100 * inter >= PERCENT * (a + b - inter)


def _block_links(key, pdf_left, pdf_right):
    """Links between members outside the largest component (left) and a block of all."""
    import pandas as pd

    found = []
    if len(pdf_left) and len(pdf_right):
        sets = [np.asarray(x) for x in pdf_right.shingles]
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, comp = pdf_right.id.to_numpy(), pdf_right.component.to_numpy()
        for one, its, own in zip(pdf_left.id, pdf_left.shingles, pdf_left.component):
            its = np.asarray(its)
            lo, hi = np.searchsorted(flat, its, "left"), np.searchsorted(flat, its, "right")
            lo, hi = lo[hi > lo], hi[hi > lo]
            if not len(lo):
                continue
            at = np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo))
            inter = np.bincount(owner[at], minlength=len(sets))
            hits = np.flatnonzero(_linked(inter, len(its), sizes) & (comp != own))
            _, pick = np.unique(comp[hits], return_index=True)
            found += [(one, ids[hits[k]]) for k in pick]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _texts(docs: DataFrame) -> DataFrame:
    """Rows that share doc_id and text have one set and one fate."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.withColumn("text_hash", F.xxhash64("text"))


def near_links(ws: Workspace, docs: DataFrame, signed: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(class of each document, component of each class that has a link).

    signed: what ``_sign`` gives. A class is all rows with one set; its id is a number of
    its own, since rows with different sets may share a doc_id. first and first_text name
    one of its rows, with the smallest doc_id.
    """
    full = signed.where("n_shingles > 0")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(least)
    # staged, so that the numbers stay
    classes = ws.keep(classes.select("set_a", "set_b", "n_shingles", F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("first_text"), F.monotonically_increasing_id().alias("id")))
    reps = ws.keep(full.join(classes.select("id", "first", "first_text"), (F.col("doc_id") == F.col("first")) & (F.col("text_hash") == F.col("first_text"))).select("id", "keys").dropDuplicates(["id"]))
    posting = reps.select("id", F.explode("keys").alias("key"))
    often = posting.groupBy("key").count().where("count > 1").withColumnRenamed("key", "of")
    order = F.sort_array(F.collect_list(F.struct("count", "key")))
    live = posting.join(often, F.col("key") == F.col("of")).groupBy("id").agg(order.alias("live"), F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("live") >= MATCHES)
    live = ws.keep(live.withColumn("live", F.transform(F.slice("live", F.lit(1), F.size("live") - (MATCHES - 1)), lambda x: x.key)))
    index = ws.keep(live.select("id", F.explode("live").alias("key")))
    keys = live.select("id", "keys")
    ids = broadcast_if_small(ws.keep(classes.join(live.select("id"), "id", "left_semi").select("id", F.col("first").alias("doc_id"), F.col("first_text").alias("text_hash"))), 24)
    shingles = ws.keep(_texts(docs).join(ids, ["doc_id", "text_hash"]).select("id", "text").mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"]))
    edges, comp = None, None
    for k in range(rounds):
        labelled = index.join(comp.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left").select("id", "key", F.coalesce("component", "id").alias("component")) if comp is not None else index.withColumn("component", F.col("id"))
        labelled = ws.keep(labelled)
        draw = F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(k), "key", "id"))
        lead = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), draw.alias("lead")).where("low < high").select(F.col("key").alias("of"), F.col("lead.id").alias("lead"), F.col("lead.component").alias("lead_component"))
        pairs = labelled.join(ws.keep(lead), F.col("key") == F.col("of")).where("component <> lead_component").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        new = _confirmed(ws, pairs, keys, shingles)
        edges = ws.keep(new if edges is None else edges.union(new))
        comp = components(ws, edges)
    labelled = ws.keep(index.join(comp.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left").select("id", "key", F.coalesce("component", "id").alias("component")))
    per = labelled.groupBy("key", "component").count()
    mixed = ws.keep(per.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.sum("count").alias("n"), F.count("*").alias("parts")).where("parts > 1").withColumnRenamed("key", "of"))
    member = labelled.join(mixed, F.col("key") == F.col("of"))
    few = ws.keep(member.where(F.col("n") <= SMALL).select("key", "id", "component", "largest"))
    far = few.select(F.col("key").alias("of"), F.col("id").alias("id2"), F.col("component").alias("component2"))
    close = few.where("component <> largest").join(far, (F.col("key") == F.col("of")) & (F.col("component") != F.col("component2")))
    edges = ws.keep(edges.union(_confirmed(ws, close.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), keys, shingles)))
    mixed = mixed.where(F.col("n") > SMALL)
    member = labelled.join(mixed, F.col("key") == F.col("of"))
    # agreement of MATCHES coordinates first, on postings alone, so that shared passages cost no sets
    outer = ws.keep(member.where("component <> largest").select("key", "id", "component"))
    other = member.select("key", F.col("id").alias("id2"), F.col("component").alias("component2"))
    asked = outer.join(keys.withColumnRenamed("id", "kid"), F.col("id") == F.col("kid")).drop("kid")
    given = ws.keep(other.join(keys.select(F.col("id").alias("kid"), F.col("keys").alias("keys2")), F.col("id2") == F.col("kid")).drop("kid"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    sized = mixed.select(F.col("of").alias("sized"), blocks.alias("blocks"))
    left = asked.join(sized, F.col("key") == F.col("sized")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", "id", "component", "keys")
    right = given.join(sized, F.col("key") == F.col("sized")).select("key", F.pmod(F.xxhash64("id2"), F.col("blocks")).cast("int").alias("block"), "id2", "component2", "keys2")
    met = ws.keep(left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInPandas(_agreeing, "key long, block int, id long, side int"))
    its = labelled.select(F.col("key").alias("lkey"), F.col("id").alias("lid"), "component")
    filled = met.join(its, (F.col("key") == F.col("lkey")) & (F.col("id") == F.col("lid"))).drop("lkey", "lid").join(shingles.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).drop("sid")
    filled = ws.keep(filled)
    last = filled.where("side = 0").groupBy("key", "block").cogroup(filled.where("side = 1").groupBy("key", "block")).applyInPandas(_block_links, "a long, b long")
    return classes, components(ws, ws.keep(edges.union(last)))


def _agreeing(key, pdf_left, pdf_right):
    """Members of the two sides that agree with one of the other in MATCHES coordinates."""
    import pandas as pd

    rows: list[tuple] = []
    if len(pdf_left) and len(pdf_right):
        n = len(pdf_right)
        lists = [np.asarray(x) for x in pdf_right.keys2]
        sizes = np.array([len(x) for x in lists])
        flat, owner = np.concatenate(lists), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        comp, hit = pdf_right.component2.to_numpy(), np.zeros(n, bool)
        ids = pdf_right.id2.to_numpy()
        for one, its, own in zip(pdf_left.id, pdf_left["keys"], pdf_left.component):
            its = np.asarray(its)
            lo, hi = np.searchsorted(flat, its, "left"), np.searchsorted(flat, its, "right")
            count = np.zeros(n, np.int64)
            for a, b in zip(lo, hi):
                count[owner[a:b]] += 1
            good = (count >= MATCHES) & (comp != own)
            if good.any():
                hit |= good
                rows.append((one, 0))
        rows += [(x, 1) for x in ids[hit]]
    out = pd.DataFrame(rows, columns=["id", "side"])
    out.insert(0, "block", pdf_left.block.iloc[0] if len(pdf_left) else 0)
    out.insert(0, "key", pdf_left["key"].iloc[0] if len(pdf_left) else 0)
    return out.astype({"key": "int64", "block": "int32", "id": "int64", "side": "int32"})


def _confirmed(ws: Workspace, pairs: DataFrame, keys: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs that agree in MATCHES coordinates and are linked on their full sets."""
    one = keys.select(F.col("id").alias("ida"), F.col("keys").alias("ka"))
    two = keys.select(F.col("id").alias("idb"), F.col("keys").alias("kb"))
    some = ws.keep(pairs.join(one, F.col("a") == F.col("ida")).join(two, F.col("b") == F.col("idb")).where(F.size(F.array_intersect("ka", "kb")) >= MATCHES).select("a", "b"))
    one = shingles.select(F.col("id").alias("ida"), F.col("shingles").alias("sa"))
    two = shingles.select(F.col("id").alias("idb"), F.col("shingles").alias("sb"))
    both = some.join(one, F.col("a") == F.col("ida")).join(two, F.col("b") == F.col("idb"))
    return both.where(_linked(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b")


def _labelled(ws: Workspace, docs: DataFrame) -> DataFrame:
    signed = ws.keep(_texts(docs).mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>"))
    classes, comp = near_links(ws, docs, signed)
    member = comp.withColumnRenamed("id", "cid")
    least = member.join(classes, F.col("id") == F.col("cid")).groupBy(F.col("component").alias("of")).agg(F.min("first").alias("least"))
    least = member.join(least, F.col("component") == F.col("of")).select("cid", "least")
    named = ws.keep(classes.join(least, F.col("id") == F.col("cid"), "left").select(F.col("set_a").alias("na"), F.col("set_b").alias("nb"), F.col("n_shingles").alias("n"), F.coalesce("least", "first").alias("component")))
    s = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b")
    out = s.join(named, (F.col("set_a") == F.col("na")) & (F.col("set_b") == F.col("nb")) & (F.col("n_shingles") == F.col("n")), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    ws = Workspace(docs.sparkSession, "near")
    return ws.finish(_labelled(ws, docs).drop("text_hash"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay (one of each component), with all columns."""
    ws = Workspace(docs.sparkSession, "near")
    gone = ws.finish(_labelled(ws, docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_text"]), "left_anti")
