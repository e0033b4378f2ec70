"""Graph operators: connected components by star contraction, family maps, guarded merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import validate
from kinfold.runtime import discard, materialise


def _state(both: DataFrame) -> tuple[int, int, bool]:
    """Of edges in both directions: their number, the most of one node, and whether a star is not a whole component yet, as a node has
    several edges up, or one and some down. One aggregation for all three."""
    up, down = F.count_if(F.expr("v < u")), F.count_if(F.expr("v > u"))
    each = both.groupBy("u").agg(F.count("*").alias("n"), ((up > 1) | (up > 0) & (down > 0)).alias("open"))
    ends, top, left = each.agg(F.sum("n"), F.max("n"), F.max("open")).first()
    return ends or 0, top or 0, bool(left)


#: Nodes with more than this many edges, and more than one in HUB_SHARE of all edges, are joined by broadcast: there are 2 * HUB_SHARE of them at most.
HUB_EDGES, HUB_SHARE = 10_000, 10_000


def _with_low(rows: DataFrame, low: DataFrame, most: int | None) -> DataFrame:
    """rows (u, v) with the m of their u; low: (u, m, n). The rows of a hub, of more than `most` edges, stay where they are, so that they do
    not gather in one task; without hubs (None) it is a plain join."""
    if most is None:
        return rows.join(low.select("u", "m"), "u")
    hub = F.col("n") > most
    hubs = F.broadcast(low.where(hub).select("u", "m"))
    found = rows.join(hubs, "u", "left").withColumnRenamed("m", "_hub")
    rest = found.where("_hub is null").join(low.where(~hub).select("u", "m"), "u")
    return found.where("_hub is not null").select("u", "v", F.col("_hub").alias("m")).unionByName(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in edges; root is the smallest node of its component.

    Alternates large-star and small-star contraction, so the number of rounds grows with
    the logarithm of the diameter. Each round is two partial aggregations and two equi-joins on the
    node, and is written to shared scratch; nodes of very many edges are joined by broadcast. Self-loops, repeated edges and edges
    with a null end are allowed; a null end is ignored. No edges: no rows.
    """
    u, v = F.col(left), F.col(right)
    ends = edges.select(u.alias("u"), v.alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    now = materialise(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends, top, unfinished = _state(both)
        if not unfinished:
            break
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        most = max(HUB_EDGES, ends // 2 // HUB_SHARE)
        most = most if top > most else None  # no node has more edges after large-star than before
        large = _with_low(both.where("v > u"), low, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        turned = _with_low(large, least, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    known = roots.unionByName(tops).distinct()
    return known.unionByName(loops.join(known.select("node"), "node", "left_anti"))


def attach_families(rows: DataFrame, families: DataFrame, key: str = "id") -> DataFrame:
    """rows with the family_id that the map (key, family_id) has for their key; an error names the first key that the map does not know."""
    known = families.select(F.col(key), F.col("family_id").alias("_family"))
    both = rows.drop("family_id").join(known, key, "left")
    if lost := both.where("_family is null").select(F.col(key).cast("string").alias("k")).orderBy("k").head(1):
        raise ValueError(f"no family is mapped for {lost[0]['k']}")
    return both.withColumnRenamed("_family", "family_id")


def family_map(ids: DataFrame, edges: DataFrame, checked: bool = True) -> DataFrame:
    """(id, family_id): connected components named by the sha256 of their sorted members; an id without edges is a family of one.

    Repeated ids, edges to unknown ids and edges given twice are errors, unless the caller has checked the tables before.
    """
    if checked:
        validate.raise_first(validate.edge_violations(ids, edges))
    roots = connected_components(edges)
    named = ids.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    label = F.sha2(F.concat_ws("\x00", F.lit("family-component-v1"), F.array_sort(F.collect_list("id"))), 256)
    return named.join(named.groupBy("root").agg(label.alias("family_id")), "root").select("id", "family_id")


def groups_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node, root, size) of components with two nodes or more, over the union of the edge tables; nodes without edges are left out."""
    both = edges.select("a", "b") if more is None else edges.select("a", "b").unionByName(more.select("a", "b"))
    roots = connected_components(both)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    return roots.join(sizes, "root").select("node", "root", "size")


def identical_edges(rows: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """(a, b): from the smallest id of each key to the others, so that a group of n has n - 1 edges."""
    least = rows.groupBy(key).agg(F.min(id_col).alias("a"))
    return rows.join(least, key).where(F.col("a") != F.col(id_col)).select("a", F.col(id_col).alias("b"))


def universe_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Undirected edges with both ends known, each once, the smaller end first; self-pairs stay."""
    known = ids.select("id")
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")


def graph_summary(families: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, families, families of several members, their files, the largest, edges."""
    sizes = families.groupBy("family_id").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    top = sizes.agg(F.sum("n").alias("files"), F.count("*").alias("families"), F.count_if(many).alias("multi_member_families"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("multi_member_files"), F.max("n").alias("largest_family"))
    return top.crossJoin(edges.agg(F.count("*").alias("edges")))


def cross_split_probability(k, p: float, q: float):
    """That a family of k files has a member in both of two splits of shares p and q, under independent assignment."""
    return 1 - F.pow(F.lit(1 - p), k) - F.pow(F.lit(1 - q), k) + F.pow(F.lit(1 - p - q), k)


def sibling_probability(k, p: float):
    """That a given member of a family of k has another member in the split of share p."""
    return 1 - F.pow(F.lit(1 - p), k - 1)


def _merge(edges: list[tuple], limit: int) -> tuple[list[str], dict]:
    """Decisions on one unguarded component's edges in order, and the smallest node of each node's final component."""
    home: dict = {}
    group: dict = {}
    said = []
    for a, b in edges:
        x, y = home.get(a, a), home.get(b, b)
        if x == y:
            said.append("within")
            continue
        gx, gy = group.get(x) or [x], group.get(y) or [y]
        if len(gx) + len(gy) > limit:
            said.append("size_guard")
            continue
        if len(gx) < len(gy):
            (x, gx), (y, gy) = (y, gy), (x, gx)
        group.pop(y, None)
        group[x] = gx + gy
        for n in gy:
            home[n] = x
        said.append("merged")
    final = {}
    for members in group.values():
        least = min(members)
        final.update(dict.fromkeys(members, least))
    return said, final


#: So many undecided pairs, about, go through one task at a time: some hundred MB of arrays.
BATCH = 8_000_000


def _merges(x, y, nx, ny, limit: int):
    """Of pairs of components 0 .. n - 1, in order, with their sizes: which pairs merge, the last label (least member) of each component, and its size.

    A pair that is the first undecided one of both its components is decided whatever the others are; rounds of these, and a plain pass over what they leave.
    """
    import numpy as np

    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    size = np.ones(n, np.int64)
    size[x], size[y] = nx, ny
    up, at, merged = np.arange(n), np.arange(len(x)), np.zeros(len(x), bool)
    keep = (x != y) & (nx + ny <= limit)
    x, y, at = x[keep], y[keep], at[keep]
    before = len(at) + 1
    while len(at) > 100_000 and before > 1.01 * len(at):
        before = len(at)
        first = np.full(n, len(merged))
        np.minimum.at(first, x, at)
        np.minimum.at(first, y, at)
        both = (first[x] == at) & (first[y] == at)
        lo, hi = np.minimum(x[both], y[both]), np.maximum(x[both], y[both])
        merged[at[both]] = True
        size[lo] += size[hi]
        up[hi] = lo
        x, y = up[x], up[y]
        keep = (x != y) & (size[x] + size[y] <= limit)
        x, y, at = x[keep], y[keep], at[keep]
    home: dict = {}

    def root(k: int) -> int:
        while (further := home.get(k)) is not None:
            home[k] = home.get(further, further)
            k = further
        return k

    for a, b, i in zip(x.tolist(), y.tolist(), at.tolist()):
        a, b = root(a), root(b)
        if a != b and size[a] + size[b] <= limit:
            lo, hi = min(a, b), max(a, b)
            home[hi], merged[i] = lo, True
            size[lo] += size[hi]
            up[hi] = lo
    while (deeper := up[up] != up).any():
        up = np.where(deeper, up[up], up)
    return merged, up, size[up]


def _batch(limit: int):
    """One batch of pairs (x, nx, y, ny, r) in a task: rows (r) of the merges, and (old, n, label, size) of the components that took part in one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        kind = rows.schema.field("x").type
        column = lambda c: rows[c].to_numpy()
        r = column("r")
        order = np.argsort(r)
        coded = pa.concat_arrays([*rows["x"].chunks, *rows["y"].chunks]).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        code = place[coded.indices.to_numpy()]
        x, y = code[: len(r)][order], code[len(r) :][order]
        nx, ny = column("nx")[order].astype(np.int64), column("ny")[order].astype(np.int64)
        merged, label, size = _merges(x, y, nx, ny, limit)
        was = np.ones(len(by_name), np.int64)
        was[x], was[y] = nx, ny
        new = np.flatnonzero(size != was)
        names = coded.dictionary.take(pa.array(by_name))
        done = r[order][merged]
        none = lambda k, t: pa.nulls(k, t)
        shape = ["r", "old", "n", "label", "size"]
        for lo in range(0, len(done), 100_000):
            part = pa.array(done[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([part, none(len(part), kind), none(len(part), pa.int64()), none(len(part), kind), none(len(part), pa.int64())], shape)
        for lo in range(0, len(new), 100_000):
            at = new[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([none(len(at), pa.int64()), names.take(pa.array(at)), pa.array(was[at]), names.take(pa.array(label[at])), pa.array(size[at])], shape)

    return run


def _labelled(rows: DataFrame, home: DataFrame | None, end: str, label: str) -> DataFrame:
    """rows with the component of their `end` as `label` and its size as n<label>; home: (node, label, size), None before the first merge."""
    if home is None:
        return rows.withColumns({label: F.col(end), f"n{label}": F.lit(1).cast("bigint")})
    found = rows.join(home.select(F.col("node").alias(end), F.col("label").alias("_l"), F.col("size").alias("_n")), end, "left")
    return found.withColumns({label: F.coalesce("_l", end), f"n{label}": F.coalesce("_n", F.lit(1).cast("bigint"))}).drop("_l", "_n")


def guarded_components(pairs: DataFrame, limit: int = 20, batch: int | None = None) -> DataFrame:
    """(a, b, score, idx, decision, component_a, component_b): single-linkage merging in order of falling score (ties: falling idx, b, a) in which
    no merge may make a component of more than `limit` nodes. decision: merged, within (both ends already together) or size_guard. Pairs with a null end are left out.

    The pairs, sorted once, are taken in batches in order. All tasks look up the components of a batch's ends, and pairs that are decided by then leave: components
    only grow, so two that are too large for the limit never come together. What is left, about `batch` pairs, is worked off in one task, so that neither memory nor the
    rows of a task grow with the input; as fewer and fewer pairs of a batch are undecided, batches grow. At the end a pair that did not merge is within if its ends share a component.
    """
    batch = BATCH if batch is None else batch
    kind = pairs.schema["a"].dataType.simpleString()
    rows = pairs.select("a", "b", F.col("score").cast("double").alias("score"), F.col("idx").cast("long").alias("idx")).where("a is not null and b is not null")
    ordered = materialise(rows.orderBy(*map(F.desc, ("score", "idx", "b", "a"))).withColumn("r", F.monotonically_increasing_id()))
    # r is the number of a partition, shifted by 33 bits, plus the row in it; the driver gets one row for each partition
    parts = ordered.groupBy(F.shiftright("r", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    total, at, step, home, told = sum(p["n"] for p in parts), 0, batch, None, []

    def place(k: int) -> int:
        for p in parts:
            if k < p["n"]:
                return (p["p"] << 33) + k
            k -= p["n"]
        return 1 << 62

    while at < total:
        taken = min(step, total - at)
        live = ordered.where((F.col("r") >= place(at)) & (F.col("r") < place(at + taken))).select("a", "b", "r")
        live = _labelled(_labelled(live, home, "a", "x"), home, "b", "y").where((F.col("x") != F.col("y")) & (F.col("nx") + F.col("ny") <= limit))
        live = materialise(live.select("x", "nx", "y", "ny", "r"))
        left = live.count()
        said = materialise(live.repartition(1).mapInArrow(_batch(limit), f"r long, old {kind}, n long, label {kind}, size long"))
        discard(live)
        told.append(said.where("r is not null").select("r"))
        moved = said.where("old is not null")
        grown = moved.where("n = 1").select(F.col("old").alias("node"), "label", "size")
        if home is not None:
            on = moved.where("n > 1").select(F.col("old").alias("label"), F.col("label").alias("_l"), F.col("size").alias("_n"))
            grown = grown.unionByName(home.join(on, "label", "left").select("node", F.coalesce("_l", "label").alias("label"), F.coalesce("_n", "size").alias("size")))
        home = materialise(grown)
        at += taken
        step = max(step, min(4 * step, batch * taken // max(1, left)))
    if home is None:
        return ordered.select("a", "b", "score", "idx", F.lit("within").alias("decision"), F.col("a").alias("component_a"), F.col("b").alias("component_b"))
    merged = told[0]
    for more in told[1:]:
        merged = merged.unionByName(more)
    out = ordered.join(merged.withColumn("merged", F.lit(True)), "r", "left")
    out = _labelled(_labelled(out, home, "a", "component_a"), home, "b", "component_b")
    same = F.col("component_a") == F.col("component_b")
    return out.select("a", "b", "score", "idx", F.when(F.col("merged"), "merged").when(same, "within").otherwise("size_guard").alias("decision"), "component_a", "component_b")
