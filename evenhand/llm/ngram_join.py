"""Groups of documents with similar word n-grams: a size-aware heavy-light Jaccard join.

Two sets that link share at least ceil(t n) elements, n being the size of either. So, in any
fixed order of the elements, their prefixes of n - ceil(t n) + k elements share k of them.

* Sets without at least k elements in their prefix for a larger k that other such sets have in
  theirs can't link with any. This leaves out texts that only share passages.
* The order puts elements that many texts share last, so that prefixes hold rare ones.
  Any order gives right results; counts within tasks and a table of bounded size are enough.
* Small sets enumerate the pairs of elements of their prefix for k = 2: equal pairs meet.
* Large sets scan the inverted lists of their prefix for k = 1. The lists also hold those
  small sets that are large enough to link with one of them.
* The boundary between small and large has the least cost, in rows, by sums over all sets.

Sets that are equal are one class from the start, so copies meet once. Sets that meet are
compared with a few pivots of their group first; only what these leave unconnected is
compared pair by pair. All comparisons are of whole sets.

Elements of a prefix that no other prefix holds bound the overlap. Let m of a's prefix be in other
prefixes, and let t elements of a stand behind its prefix. Where b's prefix ends later in the order than a's, all that
b shares of a's prefix is in b's prefix: at most m_a + t_a are shared. Else at most m_a are shared within both prefixes, and
the others stand behind b's: at most m_a + t_b. So an overlap is at most min(m_a, m_b) + max(t_a, t_b), and
pairs for which that is too little never meet. Sets with much of their own have few possible sizes of partners, often none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import Batches, texts, written

N, PERCENT = 4, 85
#: Elements in the broadcast table of frequent elements, and elements that a task counts at once.
TABLE_SIZE, COUNTED_AT_ONCE = 500_000, 4_000_000
#: Sizes of sets are told apart by so many steps for each doubling when the boundary is chosen.
SIZE_STEPS = 4
#: Most rounds of comparisons with pivots. Without another round, possible pairs are compared if they are
#: at most so many for each row that is left, or if less than LEAST_JOINED of the last round's comparisons joined components.
ROUNDS, DIRECT_PAIRS, LEAST_JOINED = 5, 1, 0.05
#: Sizes are told apart by so many steps between a set and the largest one that it can link with.
PARTNER_STEPS = 8
#: Passes that leave out sets which share too little with those that are left.
PASSES = 2
#: Keys of candidate texts and labels of nodes are broadcast up to so many rows; beyond that, joins shuffle.
BROADCAST_ROWS = 500_000
CACHE_SIZE = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd factors that tell the places of words in an n-gram apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def least_overlap(n: int) -> int:
    return (PERCENT * n + 99) // 100


def least_shared(n: Column | int) -> Column | int:
    """The k for which prefixes are emitted: half of what a set may have of its own, and 2 at least."""
    return (100 - PERCENT) * n // 200 + 2 if isinstance(n, int) else F.floor((100 - PERCENT) * n / 200) + 2


class WordHashes(dict):
    """64-bit hash of every word, worked out when the word is first met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_SIZE:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def elements(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words; fewer words are one n-gram, none give no set."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < N:
        return mixed((hashes * FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
    return np.unique(mixed(sum(hashes[k : n - N + 1 + k] * FACTORS[k] for k in range(N))))


def signature(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def frequent_elements(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that occur often in all texts, and how often tasks met them again.

    Every task counts the elements of its texts and reports those it meets in two sets or
    more; the sums are cut at the count from which TABLE_SIZE of them are left.
    """

    def repeated(batches: Batches) -> Batches:
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def counts() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            again = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(found[again].view(np.int64)), pa.array(n[again].astype(np.int64))], ["element", "n"]
            )

        for batch in batches:
            for text in texts(batch.column(0)):
                tokens = elements(text)
                mark = signature(tokens)
                if len(tokens) and mark not in seen:
                    seen.add(mark)
                    sets.append(tokens)
                    size += len(tokens)
                if size >= COUNTED_AT_ONCE:
                    yield counts()
                    sets, seen, size = [], set(), 0
        yield counts()

    found = docs.select("text").mapInArrow(repeated, "element bigint, n bigint")
    found = written(found.groupBy("element").agg(F.sum("n").alias("n")), "frequent")
    levels = found.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("elements"))
    least, total = 10_001, 0
    for level in sorted(levels.collect(), key=lambda row: -row.n):
        total += level.elements
        if total > TABLE_SIZE:
            break
        least = level.n
    table = found.filter(F.col("n") >= least).toArrow()
    tokens, n = table["element"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def described(docs: DataFrame, key: str) -> DataFrame:
    """``(key, text_key, n, sig, prefix, row)`` of every row: the size of its set, a hash of the set, its prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_elements(docs))

    def describe(batches: Batches) -> Batches:
        table, counts = frequent.value
        for batch in batches:
            sizes, marks, prefixes = [], [], []
            for text in texts(batch.column("text")):
                tokens = elements(text)
                n = len(tokens)
                sizes.append(n)
                marks.append(signature(tokens) if n else None)
                length = min(n, n - least_overlap(n) + least_shared(n))
                prefixes.append(prefix(tokens, length, table, counts).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                [key, "text_key", "n", "sig", "prefix"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        describe, f"{key} {kind}, text_key bigint, n bigint, sig binary, prefix array<bigint>"
    )
    return written(found.withColumn("row", F.monotonically_increasing_id()), "sets")


def prefix(tokens: np.ndarray, length: int, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``length`` elements by count (0 outside the table), then by hash."""
    if not len(table) or not length:
        return tokens[:length]
    at = np.minimum(np.searchsorted(table, tokens), len(table) - 1)
    known = table[at] == tokens
    rare = tokens[~known]
    if len(rare) >= length:
        return rare[:length]
    rest = tokens[known]
    return np.concatenate([rare, rest[np.argsort(counts[at[known]], kind="stable")][: length - len(rare)]])


def shared_elements(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(node, n, m, found)``: elements of each class's prefix that other classes have in theirs, in order.

    A class stays if it has enough of them; the second pass counts only classes that stayed.
    """
    first = sets.select("row", "n", "prefix").join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    postings = first.select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("rank", "element"))
    for turn in range(PASSES):
        lists = postings.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
        found = written(
            postings.join(lists.select("element"), "element")
            .groupBy("node", "n")
            .agg(F.collect_list(F.struct("rank", "element")).alias("found"))
            .withColumn("m", F.size("found"))
            .filter(F.col("m") >= F.least(least_shared(F.col("n")), F.col("n"))),
            "shared",
        )
        postings = found.select("node", "n", F.explode("found").alias("x")).select("node", "n", "x.rank", "x.element")
    return found


def in_prefix(n: Column, found: Column, k: int) -> Column:
    """The elements of the prefix for k."""
    return F.filter(found, lambda x: x["rank"] < n - F.floor((PERCENT * n + 99) / 100) + k)


def cheapest_boundary(shared: DataFrame) -> int:
    """The size up to which pairs of elements are enumerated, by the least number of rows.

    A small set takes a row for each pair of elements. A large one takes a row for each of its lists,
    and another one for the comparison there.
    """
    n, found = F.col("n"), F.col("found")
    of_pairs = F.size(in_prefix(n, found, 2)).cast("bigint")
    costs = (
        shared.groupBy(F.floor(F.log2("n") * SIZE_STEPS).alias("step"))
        .agg(
            F.sum(of_pairs * (of_pairs - 1) / 2).alias("pairs"),
            F.sum(2 * F.size(in_prefix(n, found, 1))).alias("lists"),
            F.max("n").alias("largest"),
        )
        .orderBy("step")
        .collect()
    )
    options = [(sum(cost.lists for cost in costs), 0)]
    for at, cost in enumerate(costs):
        beyond = [c for c in costs if c.largest >= least_overlap(cost.largest)] if at + 1 < len(costs) else []
        rows = sum(c.pairs for c in costs[: at + 1]) + sum(c.lists for c in beyond)
        options.append((rows, cost.largest if beyond else 2 * cost.largest + 2))
    return int(min(options)[1])


def meeting_places(shared: DataFrame, boundary: int) -> DataFrame:
    """``(place, node, n, m)``: where sets meet, by pairs of elements (small) or in inverted lists (large)."""
    by_element = F.col("of_pairs")
    pairs = F.flatten(
        F.transform(
            by_element,
            lambda a, i: F.transform(
                F.slice(by_element, i + 2, F.greatest(F.size(by_element) - i - 1, F.lit(0))),
                lambda b: F.xxhash64(F.lit(2), a, b),
            ),
        )
    )
    n, found = F.col("n"), F.col("found")
    shared = shared.withColumn("of_pairs", F.sort_array(in_prefix(n, found, 2)["element"]))
    lists = F.transform(in_prefix(n, found, 1), lambda x: F.xxhash64(F.lit(1), x["element"]))
    small = shared.filter(F.col("n") <= boundary).select(F.explode(pairs).alias("place"), "node", "n", "m")
    large = shared.filter(F.col("n") >= least_overlap(boundary)).select(
        F.explode(lists).alias("place"), "node", "n", "m"
    )
    found = small.union(large)
    several = found.groupBy("place").agg(F.count("*").alias("sets")).filter("sets > 1")
    return written(found.join(several.select("place"), "place", "left_semi"), "places")


def whole_sets(docs: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """``(node, n, elements)`` of all sets that meet another one, from their texts."""
    needed = written(
        classes.join(places.select("node").distinct(), "node", "left_semi").select("sig", "node", "n", "text_key"),
        "needed",
    )
    keys = checked(needed.select("text_key"))

    def read(batches: Batches) -> Batches:
        seen: set[bytes] = set()
        for batch in batches:
            marks, sets = [], []
            for text in texts(batch.column(0)):
                tokens = elements(text)
                mark = signature(tokens)
                if mark not in seen:
                    if len(seen) < CACHE_SIZE:
                        seen.add(mark)
                    marks.append(mark)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["sig", "elements"]
            )

    found = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi")
    found = found.select("text").mapInArrow(read, "sig binary, elements array<bigint>")
    return written(
        found.join(needed, "sig").groupBy("node").agg(F.first("n").alias("n"), F.first("elements").alias("elements")),
        "elements",
    )


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, both, all)`` of the pairs ``(a, b)``: the sizes of intersection and union of the whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), "n_a", "n_b")
    return found.select("a", "b", "both", (F.col("n_a") + F.col("n_b") - F.col("both")).alias("all"))


def checked(table: DataFrame) -> DataFrame:
    """Broadcast a written table only if it has few rows; the joins with it then move nothing."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def connected(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that the undirected edges ``(a, b)`` reach."""
    edges = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), "a").alias("label")), "labels")
    while True:
        to_b, jump = (
            checked(labels.select(F.col("node").alias(at), F.col("label").alias(name)))
            for at, name in (("b", "of_b"), ("label", "jump"))
        )
        near = edges.join(to_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("near"))
        new = near.join(checked(labels), "node").join(jump, "label", "left")
        new = written(
            new.select("node", F.col("label").alias("old"), F.least("label", "near", "jump").alias("label")), "labels"
        )
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def joined_to(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``(node, label)`` after more links between nodes."""
    a, b = (checked(labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))) for x in "ab")
    edges = links.join(a, "a").join(b, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    edges = written(edges.filter("a <> b").distinct(), "merged")
    if edges.isEmpty():
        return labels
    found = connected(edges).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return written(
        labels.join(checked(found), "label", "left").select("node", F.coalesce("new", "label").alias("label")),
        "components",
    )


def fits(a: Column, b: Column) -> Column:
    """Whether two sizes can be those of sets that link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def behind(n: Column) -> Column:
    """Elements of a set of size n that stand behind its prefix."""
    return F.greatest(F.lit(0), F.floor((PERCENT * n + 99) / 100) - least_shared(n))


def may_link(n_a: Column, m_a: Column, n_b: Column, m_b: Column) -> Column:
    """Whether sets of these sizes, with so many elements in other prefixes, can link."""
    most = F.least(m_a, m_b) + F.greatest(behind(n_a), behind(n_b))
    return fits(n_a, n_b) & ((100 + PERCENT) * most >= PERCENT * (n_a + n_b))


def size_step(n: Column) -> Column:
    return F.floor(F.log(n) * (PARTNER_STEPS / float(np.log(100 / PERCENT)))).cast("int")


def partners(rest: DataFrame) -> DataFrame:
    """``rest`` with ``(step, larger)``: the steps of size where a row meets smaller sets, and its own for larger ones.

    A row is left out where no size of a partner is possible, and where its step has only one side or one component.
    """
    n, m = F.col("n"), F.col("m")
    low, own = F.floor((PERCENT * n + 99) / 100), size_step(n)
    # Rounding moves what stands behind a prefix by less than 2 elements.
    high = F.least(n, F.floor((100 + PERCENT) * (m + behind(n) + 2) / PERCENT) - n)
    smaller_ones = F.when(high >= low, F.sequence(size_step(low), size_step(high)))
    largest = F.floor(100 * n / PERCENT)
    most = m + (PERCENT / 100 - (100 - PERCENT) / 200) * largest
    larger_ones = F.when((100 + PERCENT) * most >= PERCENT * (n + largest), F.array(own))
    none = F.array().cast("array<int>")
    smaller_ones, larger_ones = F.coalesce(smaller_ones, none), F.coalesce(larger_ones, none)
    sides = F.concat(
        F.transform(smaller_ones, lambda x: F.struct(x.alias("step"), F.lit(True).alias("larger"))),
        F.transform(larger_ones, lambda x: F.struct(x.alias("step"), F.lit(False).alias("larger"))),
    )
    both = rest.select("*", F.inline(sides))
    useful = (
        both.groupBy("place", "step")
        .agg(
            F.count_if("larger").alias("large"),
            F.count_if(~F.col("larger")).alias("small"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .filter("large > 0 and small > 0 and low <> high")
        .select("place", "step", (F.col("large") * F.col("small")).alias("pairs"))
    )
    return written(both.join(useful, ["place", "step"]), "partners")


def components(places: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, label)`` of all sets that meet another one: label is the smallest node of the component.

    In each round every place names one pivot, of the largest component there, and its other
    components' sets are compared with it. Places within one component are done, and so are sets
    that can link with no other size there. What stays apart is compared pair by pair, except where
    the bounds of overlap or the distances from the pivots rule a link out.
    """
    labels = written(sets.select("node", F.col("node").alias("label")), "components")
    places = places.withColumn("far", F.array().cast("array<double>"))
    joined = 1.0
    for turn in range(ROUNDS + 1):
        sizes = written(labels.groupBy("label").agg(F.count("*").alias("size")), "sizes")
        members = places.join(checked(labels), "node").join(checked(sizes), "label")
        # At first the set with the least elements of its own, as the origin of copies has; later any by hash.
        share = F.when(F.lit(turn == 0), F.col("m") / F.col("n"))
        order = F.struct("size", share, F.xxhash64("node", F.lit(turn)))
        open_places = (
            members.groupBy("place")
            .agg(
                F.min("label").alias("low"),
                F.max("label").alias("high"),
                F.max_by(F.struct("node", "n", "m", "label"), order).alias("pivot"),
            )
            .filter("low <> high")
            .select("place", "pivot")
        )
        # Places within one component are done for good.
        rest = written(members.drop("size").join(open_places, "place"), "open")
        if turn:
            met = partners(rest)
            rows = met.select("place", "node").distinct()
            steps = met.groupBy("place", "step").agg(F.first("pairs").alias("pairs"))
            apart = steps.agg(F.sum("pairs").alias("pairs")).collect()[0].pairs or 0
            if not apart:
                break
            left = rows.count()
            if turn == ROUNDS or apart <= DIRECT_PAIRS * left or joined < LEAST_JOINED:
                found = written(compared(possible_pairs(met), sets), "compared")
                return joined_to(labels, linked(found))
            rest = written(rest.join(rows, ["place", "node"], "left_semi"), "open")
        pivot = F.col("pivot")
        pairs = rest.filter(F.col("label") != pivot["label"])
        pairs = pairs.filter(may_link(F.col("n"), F.col("m"), pivot["n"], pivot["m"]))
        pairs = pairs.select(F.col("node").alias("a"), pivot["node"].alias("b"))
        found = written(compared(pairs.distinct(), sets), "compared")
        far = found.select(
            F.col("a").alias("node"), F.col("b").alias("pivot_node"), (1 - F.col("both") / F.col("all")).alias("new")
        )
        new = F.when(F.col("node") == F.col("pivot_node"), 0.0).otherwise(F.col("new"))
        places = rest.select("place", "node", "n", "m", "far", pivot["node"].alias("pivot_node"))
        places = places.join(checked(far), ["node", "pivot_node"], "left")
        places = places.select("place", "node", "n", "m", F.concat("far", F.array(new)).alias("far"))
        links = linked(found)
        joined = links.count() / max(1, found.count())
        labels = joined_to(labels, links)
    return labels


def linked(found: DataFrame) -> DataFrame:
    return found.filter(100 * F.col("both") >= PERCENT * F.col("all")).select("a", "b")


def possible_pairs(met: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a step of a place, of different components, that no bound rules out."""
    one, two = (
        met.filter(side).select("place", "step", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "m", "label", "far")])
        for x, side in (("a", F.col("larger")), ("b", ~F.col("larger")))
    )
    # Jaccard distance is a metric: sets that link are about as far from each pivot of their place.
    near = F.zip_with("far_a", "far_b", lambda x, y: F.coalesce(F.abs(x - y) <= 1 - PERCENT / 100 + 1e-9, F.lit(True)))
    found = one.join(two, ["place", "step"]).filter("(n_a > n_b or n_a = n_b and node_a < node_b) and label_a <> label_b")
    found = found.filter(may_link(F.col("n_a"), F.col("m_a"), F.col("n_b"), F.col("m_b")))
    return found.filter(F.forall(near, lambda x: x)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs(key, text)``.

    Rows link if the Jaccard similarity of their sets is at least PERCENT %, and
    ``component_id`` is the smallest key that links reach, the row's own included. A text without
    words, or a null one, has an empty set and links with nothing. Rows with a null key
    link as others do; a null is never the smallest key unless a component has no other.
    Repeated rows are in the component of their copies, an empty table gives no rows,
    and other columns are not read. Sets are of whole texts; that of a long one must fit in a task. Equally
    frequent elements are ordered by their hashes, which changes no link.
    """
    sets = described(docs, key)
    some = sets.filter("n > 0")
    classes = written(
        some.groupBy("sig").agg(
            F.min("row").alias("node"),
            F.min(key).alias("first_key"),
            F.first("n").alias("n"),
            F.min_by("text_key", "row").alias("text_key"),
        ),
        "classes",
    )
    shared = shared_elements(sets, classes)
    places = meeting_places(shared, cheapest_boundary(shared))
    labels = components(places, whole_sets(docs, places, classes))
    of_class = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_class.groupBy("label").agg(F.min("first_key").alias("component_id"))
    of_class = written(of_class.join(smallest, "label").select("sig", "component_id"), "members")
    full = some.join(of_class, "sig").select(key, F.col("n").alias("n_shingles"), "component_id")
    empty = sets.filter("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return full.union(empty)
