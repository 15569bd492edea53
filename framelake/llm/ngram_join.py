"""N-gram Jaccard join by a token-group matrix.

1. A partitioned count-min sketch grades every shingle by how many documents
   hold it. A document of which less than the threshold's share of shingles may
   be in any other can't have a partner (the coarsest group: all others) and is
   done. The rest keep their shingles in one global order, rarest level first.
2. Documents with equal sets are one node, whatever their number.
3. Nodes are partitioned into bounded groups of similar ones.
4. The matrix: for every prefix shingle, the groups that hold it, with their
   sizes and least place of it. The prefix principle makes some shingle of both
   prefixes common to any two linked sets; place and sizes bound the overlap.
5. For groups that a query still reaches, the union of all their shingles is
   stored. Query and union meet, and bound the overlap by what is really there.
6. Groups that qualify are opened: their members are sent, and compared exactly.

`similar_sets` does this with groups of nodes that share their least shingle
hash, and returns every link between different sets. `link_near_duplicates` only
needs components, so that one link settles a query and a group that lies within
one component. Its groups are parts of components that a reducer has found
beforehand (`leaders`): nodes with one least hash are compared with a few leaders,
and the links that this finds, true ones, shrink the matrix. Without the reducer
its result is the same.

Shingles are 64-bit keys, polynomials at bases drawn for the run
(`framelake.llm.textops`), and sets are named by 128 bits of them: no text can be
written so that it collides, and two given shingles agree with a probability of
about 2**-58. Copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from framelake.llm import sketch
from framelake.llm.components import BROADCAST_ROWS, components
from framelake.llm.substring_dedup import chunked
from framelake.llm.textops import FOLD, U64, Bases, cut_words, doc_of, draw, give_back, mix, runs_of, text_bytes, whole_text_keys, word_hashes
from framelake.llm.workspace import settle

GROUP = 256  # nodes at most, about, of a group
GROUP_TOKENS = 4_000_000  # and their shingles, while there are more than a few
ASKERS = 4 * GROUP  # queries at most, about, that one task compares with a group
SALTS = 64  # parts of a frequent key where it is joined with more rows than are broadcast
LEADERS = 4  # of a group, that go on to the next round of step 3
#: For the least hashes by which nodes are grouped, one turn after another.
TURN_SEEDS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
NODE_SEEDS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Columns of the least hashes.
TURNS = tuple(f"g{i}" for i in range(len(TURN_SEEDS)))


def shingle_sets(column: pa.ChunkedArray, n: int, bases: Bases) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the offsets of the texts."""
    give_back()
    data, offs = text_bytes(column)
    words = cut_words(FOLD[data], offs)
    hashes = word_hashes(words, bases.word)
    keys, at = runs_of(hashes, words.first, n, bases.run)
    doc = doc_of(at, words.first)
    per_doc = words.per_doc
    for k in range(1, n):  # too short for a shingle: all words are one
        short = np.flatnonzero(per_doc == k)
        if len(short):
            whole = whole_text_keys(hashes[words.first[short][:, None] + np.arange(k)], k, bases.run)
            keys, doc = np.concatenate((keys, whole)), np.concatenate((doc, short))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(per_doc) + 1))


def set_names(keys: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, which don't depend on order; None for an empty one."""
    sums = []
    for seed in NODE_SEEDS:
        total = np.zeros(len(keys) + 1, U64)
        np.cumsum(mix(keys ^ U64(seed)), dtype=U64, out=total[1:])
        sums.append(mix((total[offs[1:]] - total[offs[:-1]]) ^ np.diff(offs).astype(U64)))
    raw = np.stack(sums, axis=1).tobytes()
    return [raw[16 * i : 16 * i + 16] if size else None for i, size in enumerate(np.diff(offs))]


def _needed(size: np.ndarray | int, percent: int):
    """The least overlap that a set of this size must have with any partner."""
    return -(-size * percent // 100)


def _sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (id, text): (id, n, node) of all rows, and of every set that may have a partner (node, n, alone, tokens, g0, g1), tokens rarest first."""
    dealt, _, size, scale = chunked(docs, "id", "text", "chunk_")
    plan = sketch.plan_sketch(max(1, size // 6), scale=scale)
    bases = draw()

    def send(table: pa.Table) -> pa.Table:
        keys, counts = sketch.distinct(shingle_sets(table.column("text"), n, bases)[0])
        return sketch.send(table.column("chunk_")[0].as_py(), keys, counts, plan)

    def describe(table: pa.Table, answered: pa.Table) -> pa.Table:
        keys, offs = shingle_sets(table.column("text"), n, bases)
        distinct, inverse = np.unique(keys, return_inverse=True)
        level = sketch.levels(distinct, dict(zip(answered.column("slot").to_pylist(), answered.column("payload").to_pylist(), strict=True)), plan)[inverse]
        sizes = np.diff(offs)
        shared = np.concatenate(([0], np.cumsum(level > 1)))
        alone = sizes - (shared[offs[1:]] - shared[offs[:-1]])
        nodes = set_names(keys, offs)
        order = np.lexsort((keys, level, np.repeat(np.arange(len(sizes)), sizes)))
        ranked = keys[order]
        seen, tokens, least = set(), [], [[] for _ in TURN_SEEDS]
        for i, (node, size) in enumerate(zip(nodes, sizes, strict=True)):
            open_ = node is not None and node not in seen and size - alone[i] >= _needed(int(size), percent)
            tokens.append(ranked[offs[i] : offs[i + 1]].tobytes() if open_ else None)
            seen.add(node)
            for turn, seed in enumerate(TURN_SEEDS):
                least[turn].append(int(mix(keys[offs[i] : offs[i + 1]] ^ U64(seed)).min() >> U64(1)) if open_ else None)
        columns = [table.column("id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(alone, pa.int64()), pa.array(tokens, pa.binary()), *(pa.array(x, pa.int64()) for x in least)]
        return pa.table(columns, names=["id", "n", "node", "alone", "tokens", *TURNS])

    answers = dealt.groupBy("chunk_").applyInArrow(send, sketch.SENT).groupBy("slot").applyInArrow(lambda table: sketch.merge(table, plan.width), sketch.ANSWERED)
    schema = StructType([StructField("id", docs.schema["id"].dataType)]).add("n", "long").add("node", "binary").add("alone", "long").add("tokens", "binary")
    for g in TURNS:
        schema = schema.add(g, "long")
    known = settle(dealt.groupBy("chunk_").cogroup(answers.groupBy("chunk")).applyInArrow(describe, schema), "sets")
    return known.select("id", "n", "node"), settle(known.where("tokens is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "alone", "tokens", *TURNS))), "nodes")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): the set of each row of docs, and every two different sets with Jaccard similarity of at least percent / 100.

    members has a row (id, n_shingles, set) per row of docs, set null where a text
    has no words; rows with one set are linked with one another without a row in
    links. links has (a, b, n_shared) with a < b, once each. Sets are those of
    `link_near_duplicates`. The links of a family of near copies that are all
    different grow with its square; that is what was asked for.
    """
    known, open_sets = _sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, percent)
    grouped = _parted(open_sets.select("node", "n", F.col(TURNS[0]).cast("string").cast("binary").alias("label")))
    links = _matrix(open_sets, settle(grouped, "placed"), percent, every=True)
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_shared")
    return known.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("set")), ordered


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, leaders: bool = True) -> DataFrame:
    """One row (id, n_shingles, component_id) per row of docs; component_id is the least id reached by links.

    Sets are distinct shingles of n words, A-Z lower-cased; a text with fewer
    words is one shingle; null and empty texts have none and are linked with
    nothing. Two rows link when their sets' Jaccard similarity is at least
    percent / 100 (in integers). Rows that repeat link like others; a null id is
    larger than any. Other columns of docs are not carried. An empty table gives
    an empty result. leaders turns the reducer on, which changes the work only.
    """
    known, open_sets = _sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, percent)
    spark = docs.sparkSession
    first = settle(known.where("node is not null").groupBy("node").agg(F.min("id").alias("value"), F.count(F.lit(1)).alias("rows")), "first")
    links = spark.createDataFrame([], "a binary, b binary")
    for g in TURNS if leaders else ():
        links = links.unionByName(_lead(open_sets, g, percent))
    links = settle(links, "links")
    values = first.select("node", "value")
    labels = components(links, values=values)
    labelled = open_sets.select("node", "n").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = settle(_matrix(open_sets, settle(_parted(labelled), "placed"), percent, every=False), "links").select("a", "b")
    if rest.limit(1).count():
        labels = components(links.unionByName(rest), values=values)
    reached = first.join(labels.select("node", F.col("value").alias("reached")), "node", "left").select("node", F.coalesce("reached", "value").alias("component_id"), "rows")
    reached = settle(reached, "reached")
    # Sets that many rows have are few: their rows stay where they are.
    often = reached.where(F.col("rows") > GROUP)
    if often.count() <= BROADCAST_ROWS:
        often = F.broadcast(often.drop("rows"))
        out = known.join(often, "node").unionByName(known.join(often, "node", "left_anti").join(reached.where(F.col("rows") <= GROUP).drop("rows"), "node", "left"))
    else:
        out = known.join(reached.drop("rows"), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _with_large(rows: DataFrame, by: list[str], parts) -> DataFrame:
    """rows with parts, an aggregate by those columns, where it is above 1 (null elsewhere).

    There are few such keys: counted, they are broadcast; were they many, both
    sides would be salted. So the rows of a frequent key never meet in one task.
    """
    large = settle(rows.groupBy(*by).agg(parts.alias("parts")).where("parts > 1"), "large")
    if large.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(large), by, "left")
    salted = large.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.hash("node"), F.lit(SALTS))).join(salted, [*by, "salt_"], "left").drop("salt_")


def _split(by: str = "node"):
    """Which of its key's parts a row is in."""
    return F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))


def _parts():
    """Parts of a group: bounded in nodes and, while a part has a few nodes, in shingles."""
    count = F.count(F.lit(1))
    return F.ceil(F.greatest(count / GROUP, F.least(F.sum("n") / GROUP_TOKENS, count / (4 * LEADERS))))


def _parted(labelled: DataFrame) -> DataFrame:
    """(node, n, label, rank, part): labelled's groups in bounded parts; rank grows with the group."""
    return _with_large(labelled, ["label"], _parts()).select("node", "n", "label", F.coalesce("parts", F.lit(1)).alias("rank"), _split().alias("part"))


def _token_lists(column) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in column.to_pylist()]


def _lead(sets: DataFrame, turn: str, percent: int) -> DataFrame:
    """Links that join each group's nodes into components; groups are nodes with one least hash, split while too large.

    Leaders of a split group's largest components go on to meet the other parts'.
    """

    def lead(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes, lists = table.column("node").to_pylist(), [np.sort(t) for t in _token_lists(table.column("tokens"))]
        sizes = np.array([len(t) for t in lists])
        owner = np.repeat(np.arange(len(lists)), sizes)
        flat = np.concatenate(lists)
        left = np.ones(len(lists), bool)
        a, b, leads = [], [], []
        while left.any():
            first = int(np.flatnonzero(left)[0])
            left[first] = False
            reached = [first]
            for probe in reached:  # grows while it is walked
                if not left.any():
                    break
                live = left[owner]
                flat, owner = flat[live], owner[live]
                shared = _overlaps(flat, owner, lists[probe], len(lists))
                hit = np.flatnonzero(left & (100 * shared >= percent * (sizes + sizes[probe] - shared)))
                left[hit] = False
                reached += hit.tolist()
                a += [nodes[probe]] * len(hit)
                b += [nodes[i] for i in hit]
            leads.append((len(reached), first))
        leads = [i for _, i in sorted(leads, reverse=True)[:LEADERS]] if table.column("more")[0].as_py() else []
        column = lambda values, kind: pa.array(values, kind)
        return pa.table({
            "a": column(a + [nodes[i] for i in leads], pa.binary()),
            "b": column(b + [None] * len(leads), pa.binary()),
            "g": column([key[0].as_py()] * (len(a) + len(leads)), pa.int64()),
            "tokens": column([None] * len(a) + [lists[i].tobytes() for i in leads], pa.binary()),
        })

    grouped = sets.select("node", "n", F.col(turn).alias("g"), "tokens")
    links = None
    while True:
        parted = _with_large(grouped, ["g"], _parts()).select("g", _split().alias("part"), "node", "tokens", F.col("parts").isNotNull().alias("more"))
        found = settle(parted.groupBy("g", "part").applyInArrow(lead, "a binary, b binary, g long, tokens binary"), "led")
        new = found.where("b is not null").select("a", "b")
        links = new if links is None else links.unionByName(new)
        grouped = found.where("b is null").select(F.col("a").alias("node"), (F.octet_length("tokens") / 8).alias("n"), "g", "tokens")
        if not grouped.limit(1).count():  # no group was split
            return links


def _overlaps(flat: np.ndarray, owner: np.ndarray, query: np.ndarray, n: int) -> np.ndarray:
    """How many of each owner's tokens the query (ascending) has."""
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    return np.bincount(owner[query[at] == flat], minlength=n)


def _matrix(sets: DataFrame, placed: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (a, b, n_shared) between nodes of placed's groups.

    Every link if so asked; else those between groups of different labels, one at
    least for each node and group between which there is any.
    """

    def prefix(batches):
        for b in batches:
            token, place, row = [], [], []
            for i, (t, alone) in enumerate(zip(_token_lists(b.column("tokens")), b.column("alone").to_numpy(), strict=True)):
                stop = len(t) - _needed(len(t), percent) + 1
                if stop > alone:  # shingles that no other holds come first and match nothing
                    token.append(t[alone:stop].view(np.int64))
                    place.append(np.arange(alone, stop))
                    row.append(np.full(stop - alone, i))
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(place), pa.int64()), *(b.column(c).take(row) for c in ("node", "n", "label", "rank", "part"))], names=["token", "place", "node", "n", "label", "rank", "part"])

    schema = "token long, place long, node binary, n long, label binary, rank long, part long"
    prefixes = settle(sets.select("node", "alone", "tokens").join(placed, "node").mapInArrow(prefix, schema), "prefixes")
    met = F.count(F.lit(1)) > 1 if every else F.min("label") != F.max("label")
    prefixes = settle(prefixes.join(prefixes.groupBy("token").agg(met.alias("met")).where("met").select("token"), "token"), "spanning")
    matrix = prefixes.groupBy("token", F.col("label").alias("g_label"), F.col("rank").alias("g_rank"), F.col("part").alias("g_part")).agg(F.min("place").alias("g_place"), F.min("n").alias("least"), F.max("n").alias("most"))
    # |A & B| >= p (|A| + |B|) / (100 + p) follows from |A & B| >= p |A | B| / 100.
    bound = (1 + F.least(F.col("n") - F.col("place") - 1, F.col("most") - F.col("g_place") - 1)) * (100 + percent) >= percent * (F.col("n") + F.col("least"))
    # The smaller group's nodes ask, the larger one's parts are asked.
    asks = F.struct("rank", "label") < F.struct(F.col("g_rank").alias("rank"), F.col("g_label").alias("label"))
    if every:
        asks = asks | ((F.col("label") == F.col("g_label")) & (F.col("part") <= F.col("g_part")))
    group = ["g_label", "g_part"]
    pairs = settle(prefixes.join(matrix, "token").where(asks & bound).select("node", "n", *group).distinct(), "pairs")
    if not pairs.limit(1).count():
        return sets.sparkSession.createDataFrame([], _LINK)
    slices = F.ceil(F.greatest(F.count(F.lit(1)) / ASKERS, F.sum("n") / GROUP_TOKENS))
    pairs = settle(_with_large(pairs, group, slices).select("node", *group, _split().alias("slice"), F.coalesce("parts", F.lit(1)).alias("slices")), "asked")
    tokens = sets.select("node", "tokens")
    held = placed.select("node", F.col("label").alias("g_label"), F.col("part").alias("g_part"))
    asked = pairs.groupBy(*group).agg(F.max("slices").alias("slices"))
    # The unions of the groups that are asked, stored: members are sent once here, and again only where a group is opened.
    members = held.join(asked, group).join(tokens, "node")
    unions = settle(members.groupBy(*group).applyInArrow(_union, "g_label binary, g_part long, slices long, least long, tokens binary"), "unions")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    queries = pairs.select("node", *group, "slice").join(tokens, "node").select("node", *group, "slice", "tokens", F.lit(None).cast("long").alias("least"))
    both = queries.unionByName(unions.select(F.lit(None).cast("binary").alias("node"), *group, each, "tokens", "least"))
    keys = [*group, "slice"]
    qualified = settle(both.groupBy(*keys).applyInArrow(_bound(percent), "node binary, g_label binary, g_part long, slice long"), "qualified")
    opened = held.join(qualified.select(*keys).distinct(), group)
    roles = qualified.withColumn("asks", F.lit(True)).unionByName(opened.withColumn("asks", F.lit(False)))
    return roles.join(tokens, "node").groupBy(*keys).applyInArrow(_open(percent, every), _LINK)


_LINK = "a binary, b binary, n_shared long"


def _union(table: pa.Table) -> pa.Table:
    """One row for a group: all its members' shingles, once each, ascending, and the size of its least member."""
    lists = _token_lists(table.column("tokens"))
    union = np.unique(np.concatenate(lists))
    kept = table.select(["g_label", "g_part", "slices"]).slice(0, 1)
    return kept.append_column("least", pa.array([min(map(len, lists))], pa.int64())).append_column("tokens", pa.array([union.tobytes()], pa.binary()))


def _bound(percent: int):
    """The queries of which a group's union holds enough for a link with its least member."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        at = nodes.index(None)
        union, least = np.frombuffer(table.column("tokens")[at].as_py(), U64), table.column("least")[at].as_py()
        kept = []
        for i, query in enumerate(_token_lists(table.column("tokens"))):
            if nodes[i] is not None:
                place = np.minimum(np.searchsorted(union, query), len(union) - 1)
                shared = int(np.count_nonzero(union[place] == query))
                if shared >= _needed(len(query), percent) and shared * (100 + percent) >= percent * (len(query) + least):
                    kept.append(i)
        return table.select(["node", "g_label", "g_part", "slice"]).take(pa.array(kept, pa.int64()))

    return run


def _open(percent: int, every: bool):
    """Compares queries with a group's members: all links of a query, or its first."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        nodes, lists = table.column("node").to_pylist(), _token_lists(table.column("tokens"))
        held = [i for i in range(len(nodes)) if not asks[i]]
        inside = {nodes[i] for i in held}
        flat = np.concatenate([lists[i] for i in held])
        sizes = np.array([len(lists[i]) for i in held])
        owner = np.repeat(np.arange(len(held)), sizes)
        a, b, n = [], [], []
        for i in np.flatnonzero(asks):
            shared = _overlaps(flat, owner, np.sort(lists[i]), len(held))
            hits = np.flatnonzero(100 * shared >= percent * (sizes + len(lists[i]) - shared))
            if every:  # two members of one group ask one another: the smaller's answer counts
                hits = [k for k in hits if nodes[i] < nodes[held[k]] or nodes[i] not in inside]
            for k in hits if every else hits[:1]:
                a.append(nodes[i])
                b.append(nodes[held[k]])
                n.append(int(shared[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n_shared": pa.array(n, pa.int64())})

    return run
