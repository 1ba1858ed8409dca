"""Embedding near-duplicates by NN-descent.

Vectors are compared only within an equal label (and length).  Exact copies are one class.

1. Start: in each of several tables the classes are sorted by the signs of random
   projections; every class meets the WINDOW classes next to it in the order, whatever the
   size of a group.
2. Descent: every class sends the vectors of its nearest and reverse neighbours to one place,
   where they are compared with each other; the LIST best of each are kept; repeated until few
   lists change.  Links that were computed count whether or not a list has room for them: of
   each step a spanning forest of its links is kept beside the lists.
3. Enlarged lists: a list that is full of links is saturated and may miss more.  Links
   form components.  Saturated classes get a second list, of the LIST best outside their own
   component, from windows that double and from descent; repeated until no component grows.
   Then each component is finished exactly: small ones by one matrix product, large ones by
   blocks of BLOCK members sorted by their angle to the component's centre.  By the triangle
   inequality two members whose angles add up to at most the threshold angle are linked
   and two whose angles differ by more are not; only blocks in between are multiplied.
4. Audit: AUDIT classes of all and AUDIT of those with few links found are compared with all
   rows in blocks.  Recall is the mean over the audited classes that have links, of each of the
   two samples, so a large group can't hide small ones.  While it is under RECALL, tables and
   windows double.  After MAX_TURNS turns all classes are compared with all others (quadratic,
   exact), so no result is returned that missed the audit.

Counts of links are summed, pairs of members are never emitted.

Defined results: null labels link with nothing, nor do vectors that are null, zero or hold null
or non-finite components; repeated rows are vectors of their own; an empty table gives an empty
result.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricesieve.llm.common import staged
from pricesieve.llm.components import connected_components

THRESHOLD = 0.98
TABLES = 8
PLANES = 40
WINDOW = 6
LIST = 10
#: Candidates under this cosine are no use as neighbours.
FLOOR = 0.9
MAX_ROUNDS = 4
#: A round that changes less than this share of all lists is the last.
FEW = 0.002
BLOCK = 1024
AUDIT = 512
#: Classes with at most this many links found are audited by a sample of their own.
FEW_LINKS = 32
RECALL = 0.98
MAX_TURNS = 3
#: Bytes of vectors that one pass of the exact path holds.
PASS_BYTES = 32 << 20
PAIRS = "a long, b long, sim double, must boolean"
#: Rows that a task of a grouped step gets, about.
TASK_ROWS = 20_000


def _matrix(column) -> np.ndarray:
    """Arrow column of equally long lists -> rows scaled to length 1."""
    flat = np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten())
    x = flat.astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(id, least, label, dim, n, v): distinct usable vectors of a label with an id of their own (a
    vec_id may occur with several vectors), their least vec_id and how often they occur; a staged
    table."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(
        "label IS NOT NULL AND v IS NOT NULL AND vec_id IS NOT NULL "
        "AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    return staged(rows.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                  .select(F.monotonically_increasing_id().alias("id"), "least", F.col("label").cast("string").alias("label"), F.size("v").alias("dim"), "n", "v"), "classes")


def _forest(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Marks the pairs of a spanning forest of all links among the pairs: it has the links'
    components and fewer links than nodes."""
    marks = np.zeros(len(a), dtype=bool)
    at = np.flatnonzero(sim >= THRESHOLD)
    nodes, ends = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
    i, j = ends[:len(at)], ends[len(at):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[i], root[j]
        between = np.flatnonzero(p != q)
        if not len(between):
            return marks
        # the first link out of every component closes no ring
        first = np.full(len(nodes), len(at))
        np.minimum.at(first, p[between], between)
        np.minimum.at(first, q[between], between)
        taken = np.unique(first[first < len(at)])
        marks[at[taken]] = True
        least, old = np.arange(len(nodes)), None
        while old is None or (least != old).any():
            old = least
            low = np.minimum(old[p[taken]], old[q[taken]])
            least = old.copy()
            np.minimum.at(least, p[taken], low)
            np.minimum.at(least, q[taken], low)
            least = least[least]
        root = least[root]


def _by_signs(classes: DataFrame, seed: int, tables: int, window: int) -> DataFrame:
    """(a, b, sim, must): classes next to each other in an order by projection signs; must
    marks a spanning forest of the links."""
    def keys(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            dims, out = np.asarray(b.column("dim")), []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                x = _matrix(part.column("v"))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((dim, PLANES))
                    bits = (x @ planes > 0) @ (1 << np.arange(PLANES, dtype=np.int64))
                    out.append(pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("label"), part.column("dim"), part.column("v"),
                         pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(bits)],
                        names=["id", "label", "dim", "v", "tab", "bits"]))
            yield from out

    def meet(batches):
        import pyarrow as pa

        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            if held is not None:
                table = pa.concat_tables([held, table])
            fresh = 0 if held is None else held.num_rows
            n = table.num_rows
            if n > 1:
                group = list(zip(table["label"].to_pylist(), table["dim"].to_pylist(), table["tab"].to_pylist()))
                starts = [0, *[i for i in range(1, n) if group[i] != group[i - 1]], n]
                ids, out = np.asarray(table["id"]), []
                for lo, hi in zip(starts, starts[1:]):
                    if hi - lo < 2:
                        continue
                    x = _matrix(table["v"].slice(lo, hi - lo))
                    own = ids[lo:hi]
                    for k in range(1, min(window, hi - lo - 1) + 1):
                        sim = np.einsum("ij,ij->i", x[:-k], x[k:])
                        near = np.flatnonzero((sim >= FLOOR) & (np.arange(lo + k, hi) >= fresh))
                        if len(near):
                            out.append((own[near], own[near + k], sim[near]))
                if out:
                    a, b, sim = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (a, b, sim, _forest(a, b, sim)))], names=["a", "b", "sim", "must"])
            held = table.slice(max(0, n - window))

    keyed = classes.select("id", "label", "dim", "v").mapInArrow(
        keys, "id long, label string, dim int, v array<double>, tab int, bits long")
    order = ["label", "dim", "tab", "bits", "id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(meet, PAIRS)


def _lists(pairs: DataFrame) -> DataFrame:
    """(a, b, sim, must, best): the LIST best of each class (best), both ways round, and the
    pairs that must stay."""
    both = pairs.select("a", "b", "sim", "must").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "must"))
    each = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("must").alias("must"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return each.withColumn("best", rank <= LIST).where("best OR must")


def _join_neighbours(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, sim, must): neighbours of each class, reverse ones too, compared with each other;
    must marks a spanning forest of the links.  lists: (a, b, sim, far); near and far
    neighbours have a limit each."""
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "far")
    rank = F.row_number().over(Window.partitionBy("a", "far").orderBy(F.desc("sim"), "b"))
    around = lists.select("a", "b", "sim", "far").unionAll(back).distinct().withColumn("_r", rank).where(F.col("_r") <= 2 * LIST)
    rows = around.select(F.col("a").alias("at"), F.col("b").alias("id")).join(classes.select("id", "v"), "id")

    def compare(table):
        import pyarrow as pa

        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        at, ids, out = np.asarray(table["at"]), np.asarray(table["id"]), []
        x = _matrix(table["v"])
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], len(at)]):
            i, j = np.nonzero(np.triu(x[lo:hi] @ x[lo:hi].T >= FLOOR, 1))
            if len(i):
                out.append((ids[lo + i], ids[lo + j], np.einsum("ij,ij->i", x[lo + i], x[lo + j])))
        a, b, sim = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table({"a": a, "b": b, "sim": sim, "must": _forest(a, b, sim)})

    n = lists.count()
    tasks = max(1, math.ceil(2 * n / TASK_ROWS))
    return (rows.withColumn("_task", F.pmod(F.xxhash64("at", "at"), F.lit(tasks)))
            .groupBy("_task").applyInArrow(_without(compare), PAIRS))


def _without(run):
    return lambda table: run(table)


def neighbour_graph(classes: DataFrame, seed: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b, sim, must, best): NN-descent from the sign tables of turn ``seed``, twice as many
    and as wide each turn, and a graph known before."""
    start = _by_signs(classes, seed, TABLES << seed, WINDOW << seed)
    graph = staged(_lists(start if known is None else start.unionAll(known.select(start.columns))), "lists")
    for _ in range(MAX_ROUNDS):
        near = graph.where("best").withColumn("far", F.lit(False))
        new = staged(_lists(graph.select("a", "b", "sim", "must").unionAll(_join_neighbours(near, classes))), "lists")
        best = new.where("best")
        changed, total = best.join(graph.where("best"), ["a", "b"], "left_anti").count(), best.count()
        graph = new
        if changed <= FEW * total:
            break
    return graph


def enlarged(classes: DataFrame, graph: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The graph and its components (node, root), after saturated classes (whose whole list is
    links) were compared with more classes outside their components until no component grew."""
    full = (graph.where("best").groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
            .where((F.col("n") >= LIST) & (F.col("least") >= THRESHOLD)).select(F.col("a").alias("id")))
    saturated = staged(classes.join(full, "id", "left_semi"), "saturated")
    near = graph.where("best").withColumn("far", F.lit(False))
    far, window, before = near.limit(0), WINDOW, -1
    some = saturated.limit(1).count() > 0
    while True:
        comps = staged(connected_components(graph.where(F.col("sim") >= THRESHOLD).select("a", "b")), "components")
        merged = comps.where("node <> root").count()
        if not some or merged == before:
            return graph, comps
        before, window = merged, 2 * window
        found = _by_signs(saturated, seed, TABLES, window).unionAll(
            _join_neighbours(near.select("a", "b", "sim", "far").unionAll(far.select("a", "b", "sim", "far")), saturated))
        root = [comps.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        outside = found.join(root[0], "a").join(root[1], "b").where("ra <> rb").select(found.columns)
        outside = outside.unionAll(far.join(root[0], "a").join(root[1], "b").where("ra <> rb").select(found.columns))
        far = staged(_lists(outside), "far").withColumn("far", F.lit(True))
        # the new links keep their components together, whatever the lists hold
        graph = graph.unionAll(far.where(F.col("sim") >= THRESHOLD).withColumn("must", F.lit(True))
                               .withColumn("best", F.lit(False)).select(graph.columns))


def _finish(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, links): for every class of a component the rows of other classes linked to it."""
    members = staged(classes.join(comps.withColumnRenamed("node", "id"), "id").select("root", "id", "n", "v"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    members = members.join(sizes, "root")
    tasks = max(1, math.ceil(members.count() / TASK_ROWS))

    def small(table):
        import pyarrow as pa

        table = table.sort_by([("root", "ascending"), ("id", "ascending")])
        root, n, x = np.asarray(table["root"]), np.asarray(table["n"]), _matrix(table["v"])
        links = np.zeros(len(root), dtype=np.int64)
        starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], len(root)]):
            linked = x[lo:hi] @ x[lo:hi].T >= THRESHOLD
            np.fill_diagonal(linked, False)
            links[lo:hi] = linked @ n[lo:hi]
        return pa.table({"id": table["id"], "links": pa.array(links)})

    done = (members.where(F.col("size") <= BLOCK).withColumn("_task", F.pmod(F.xxhash64("root", "root"), F.lit(tasks)))
            .groupBy("_task").applyInArrow(_without(small), "id long, links long"))
    return done.unionAll(_finish_large(members.where(F.col("size") > BLOCK)))


def _finish_large(members: DataFrame) -> DataFrame:
    """(id, links) of the members of large components, by blocks."""
    angle = math.acos(THRESHOLD)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = members.select("root", "id", "n", F.transform("v", lambda x: x / length).alias("v"))
    centre = (unit.select("root", F.posexplode("v").alias("k", "x")).groupBy("root", "k").agg(F.avg("x").alias("x"))
              .groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c")))
    dot = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    rows = unit.join(centre, "root").select(
        "root", "id", "n", "v", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / size))).alias("angle"))

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            root = np.asarray(b.column("root"))
            edges = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
            for lo, hi in zip(edges, edges[1:]):
                for at in range(lo, hi, BLOCK):
                    cut = b.slice(at, min(BLOCK, hi - at))
                    a, n = np.asarray(cut.column("angle")), np.asarray(cut.column("n"))
                    yield pa.RecordBatch.from_pydict({
                        "root": [int(root[at])], "block": [f"{part}-{number}"], "low": [float(a.min())], "high": [float(a.max())],
                        "rows": [int(n.sum())], "ids": [np.asarray(cut.column("id")).astype("<i8").tobytes()],
                        "ns": [n.astype("<i8").tobytes()], "x": [_matrix(cut.column("v")).astype("<f8").tobytes()]})
                    number += 1

    block = staged(rows.repartitionByRange("root", "angle", "id").sortWithinPartitions("root", "angle", "id").mapInArrow(
        blocks, "root long, block string, low double, high double, rows long, ids binary, ns binary, x binary"), "blocks")
    light = block.select("root", "block", "low", "high", "rows")
    other = light.select("root", *(F.col(c).alias(f"o_{c}") for c in ("block", "low", "high", "rows")))
    near = light.join(other, "root").where(F.col("o_low") - F.col("high") <= angle + 1e-9).where(
        F.col("low") - F.col("o_high") <= angle + 1e-9)
    sure = F.col("high") + F.col("o_high") <= angle - 1e-9
    whole = near.where(sure).groupBy("block").agg(F.sum("o_rows").alias("sure"))
    tested = near.where(~sure).select("block", "o_block")
    heavy = block.select("block", "ids", "ns", "x")
    pairs = (tested.join(heavy.select("block", "ids", "x"), "block")
             .join(heavy.select(F.col("block").alias("o_block"), F.col("ids").alias("o_ids"), F.col("ns").alias("o_ns"),
                                F.col("x").alias("o_x")), "o_block"))

    def multiply(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, other_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["o_ids"], "<i8")
                x, y = (np.frombuffer(r[k]).reshape(len(i), -1) for k, i in (("x", ids), ("o_x", other_ids)))
                linked = (x @ y.T >= THRESHOLD) @ np.frombuffer(r["o_ns"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.astype(np.int64))], names=["id", "links"])

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids, ns = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["ns"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((r["sure"] or 0) - ns)], names=["id", "links"])

    counted = pairs.select("ids", "x", "o_ids", "o_ns", "o_x").mapInArrow(multiply, "id long, links long")
    own = heavy.select("block", "ids", "ns").join(whole, "block", "left").select("ids", "ns", "sure").mapInArrow(
        spread, "id long, links long")
    return counted.unionAll(own).groupBy("id").agg(F.sum("links").alias("links"))


def audit(classes: DataFrame, links: DataFrame) -> float:
    """Mean share of a class's true links (by comparison with all rows, in blocks) that were
    found, over the audited classes that have any: the lower one of a sample of all classes and
    a sample of those with at most FEW_LINKS links found; 1 if there are none."""
    found = classes.join(links, "id", "left").select("id", "label", "dim", "v", F.coalesce("links", F.lit(0)).alias("links"))
    order = F.xxhash64("id", F.lit(7))
    samples = [d.orderBy(order).limit(AUDIT).collect() for d in (found, found.where(F.col("links") <= FEW_LINKS))]
    chosen = {r.id: r for sample in samples for r in sample}
    asked: dict = {}
    for r in chosen.values():
        asked.setdefault((r.label, r.dim), []).append((r.id, np.array(r.v) / np.linalg.norm(r.v)))
    asked = {k: (np.array([i for i, _ in rows]), np.array([x for _, x in rows])) for k, rows in asked.items()}
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist()))
            for key in set(keys) & set(shared.value):
                part = b.take(pa.array([i for i, k in enumerate(keys) if k == key]))
                ids, q = shared.value[key]
                linked = q @ _matrix(part.column("v")).T >= THRESHOLD
                linked &= ids[:, None] != np.asarray(part.column("id"))[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(linked @ np.asarray(part.column("n")))], names=["id", "links"])

    true = (classes.select("id", "label", "dim", "n", "v").mapInArrow(run, "id long, links long")
            .groupBy("id").agg(F.sum("links").alias("true")))
    true = {r.id: r.true for r in true.where(F.col("true") > 0).collect()}
    shares = [[min(1.0, r.links / true[r.id]) for r in sample if r.id in true] for sample in samples]
    return min((sum(x) / len(x) for x in shares if x), default=1.0)


def _all_links(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, b): for every two components (or single classes) that any link joins, their roots.
    All classes are compared with all others, one part of them at a time."""
    rows = staged(classes.join(comps.withColumnRenamed("node", "id"), "id", "left")
                  .select("id", "label", "dim", "v", F.coalesce("root", "id").alias("root")), "rooted")
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    parts, out = math.ceil(n * 8 * dim / PASS_BYTES), []
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        asked: dict = {}
        for i, key in enumerate(zip(held["label"].to_pylist(), held["dim"].to_pylist())):
            asked.setdefault(key, []).append(i)
        asked = {k: (np.asarray(held["root"].take(at)), _matrix(held["v"].take(at))) for k, at in asked.items()}
        shared = rows.sparkSession.sparkContext.broadcast(asked)

        def run(batches, shared=shared):
            import pyarrow as pa

            for b in batches:
                at: dict = {}
                for i, key in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist())):
                    at.setdefault(key, []).append(i)
                for key in at.keys() & shared.value.keys():
                    part = b.take(pa.array(at[key]))
                    own, x, (root, y) = np.asarray(part.column("root")), _matrix(part.column("v")), shared.value[key]
                    for lo in range(0, len(own), BLOCK):
                        for at_ in range(0, len(root), BLOCK):
                            i, j = np.nonzero(x[lo:lo + BLOCK] @ y[at_:at_ + BLOCK].T >= THRESHOLD)
                            pairs = np.stack([own[lo + i], root[at_ + j]], axis=1)
                            pairs = np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)
                            if len(pairs):
                                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        out.append(staged(rows.mapInArrow(run, "a long, b long").distinct(), "all_links"))
        shared.unpersist()
    links = out[0]
    for more in out[1:]:
        links = links.unionAll(more)
    return links


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes, graph = classes_of(vectors), None
    for turn in range(MAX_TURNS):
        graph, comps = enlarged(classes, neighbour_graph(classes, turn, graph), turn)
        links = staged(_finish(classes, comps), "links")
        if audit(classes, links) >= RECALL:
            break
    else:
        known = comps.select(F.col("node").alias("a"), F.col("root").alias("b"))
        comps = staged(connected_components(known.unionAll(_all_links(classes, comps))), "components")
        links = staged(_finish(classes, comps), "links")
    comps = comps.withColumnRenamed("node", "id")
    first = classes.select("id", "least").join(comps, "id").groupBy("root").agg(F.min("least").alias("first"))
    named = comps.join(first, "root").select("id", "first")
    found = (classes.select("label", "v", "id", "least", "n").join(links, "id", "left").join(named, "id", "left")
             .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("first", "least").alias("component_id")))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = rows.join(found, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
