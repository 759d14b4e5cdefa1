"""Exact n-gram Jaccard self-join by a token-group matrix.

Similar documents are put into groups, each group stores the union of its members' shingles, a
query document's overlap with a union bounds its similarity to every member, and only groups
whose bound reaches the threshold are opened. The parts:

1. Documents with equal shingle sets are one class; one representative goes on.
2. Which groups a document can qualify for at all follows from a pigeonhole. Two sets with
   Jaccard >= t differ in at most k = (1-t)/(1+t) * (|A|+|B|) shingles, so of more than k
   segments of the shingle space one is equal in both. A document looks up the hash of each
   segment's content (small sets: each shingle) in the column of the matrix; the least document of
   a posting names the group. There are a few segments more than k + 1, so similar sets share
   several keys, s at least, and a document can spare the s - 1 most frequent of its keys: the
   rarest key that two similar sets share stays with both. So keys that many documents share, as
   those of a common passage, lead to a comparison only where the documents have too few others.
3. A group is worked in parts of at most `group_rows` documents plus its leader. A part links
   its members by comparing one leader after another with all; a document that a leader has
   reached leads no more. If the part is in several components then, the documents outside the
   largest one are compared with all too, so no link between reached documents is lost.
4. Where a key's documents are in several components by then, those outside its commonest
   component open the other groups of the key, if the overlap with the group's union reaches
   t * |A|. A document is looked for in the part it was dealt to, not where it only leads, and a
   document asks a group once, whatever the number of their keys and of the group's parts.
   Histograms bound that overlap from above, so most parts are excluded before any shingles are
   moved.

Every link's two documents end in one component; no pair within a group is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimworks.llm import _store, _text
from claimworks.llm.components import components

_U = np.uint64
BUCKETS = 128  # of a set's histogram, by the first bits of its shingles
FULL = 255  # a bucket's count from here on is unknown
SMALL = 64  # sets below about this size look up single shingles


class Scheme:
    """The threshold num / den and what follows from it for sets of a size."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
        self.edges = np.array(edges)  # band b holds the sizes edges[b] <= n < edges[b + 1]

    def least(self, n: int) -> int:
        """The least overlap of a set of size n with any similar one: ceil(t * n)."""
        return -(-n * self.num // self.den)

    def linked(self, common, a, b):
        return common * self.den >= self.num * (a + b - common)

    def segments(self, band: int) -> tuple[int, int]:
        """Segments of a band, and how many of them are equal in two similar sets at least."""
        k = 2 * (int(self.edges[band + 1]) - 1) * (self.den - self.num) // (self.den + self.num)
        return k + 1 + k // 8, 1 + k // 8

    def keys(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """The posting keys of one sorted set, those of its own band and of the next, where a larger
        similar set can be, each with how many of them the set can spare: one less than it shares
        with any similar set of the larger one's band at least."""
        n, out = len(tokens), []
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        for band in (own, own + 1):
            if self.edges[band + 1] <= SMALL:
                if not out:  # the same shingles serve both bands
                    out.append((_text.mix(tokens ^ _U(_text.mix1(17))), self.least(n) - 1))
                continue
            salt = _text.mix1(band * 0x9E3779B97F4A7C15 + 17)
            m, equal = self.segments(band)
            mixed = _text.mix(tokens ^ _U(0xA24BAED4963EE407))
            segment = (tokens % _U(m)).astype(np.int64)
            content = np.zeros(m, _U)
            np.add.at(content, segment, mixed)
            filled = np.bincount(segment, minlength=m) > 0
            empty = m - int(filled.sum())
            if empty < equal:  # an equal segment is one with shingles in it
                content = content[filled]
                at = np.flatnonzero(filled)
            else:
                at = np.arange(m)
            out.append((_text.mix(content + at.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(salt)), max(equal - empty, 1) - 1))
        return out


def _sets(batches, k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, first (offsets of the rows' sets), shingles, rows."""
    for batch in _text.released(batches):
        for i, j, data, offsets in _text.chunks(batch.column(1)):
            words = _text.Words(data, offsets)
            row, h = _text.shingles(words.hash(), words.first, k)
            row, h, _ = _text.distinct(row, h)
            yield batch.column(0).slice(i, j - i), np.searchsorted(row, np.arange(j - i + 1)), h, row


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size) and two sums over the set that tell sets apart."""

    def run(batches):
        for ids, first, h, _ in _sets(batches, k):
            one, two = _text.sums(_text.mix(h)), _text.sums(_text.mix(h ^ _U(0x5851F42D4C957F2D)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(_text.signed(one[first[1:]] - one[first[:-1]])), pa.array(_text.signed(two[first[1:]] - two[first[:-1]]))], ["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _postings(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    def run(batches):
        for ids, first, h, _ in _sets(batches, k):
            keys, doc, spare = [np.zeros(0, _U)], [], []
            for name, a, b in zip(ids.to_pylist(), first[:-1], first[1:], strict=True):
                for found, most in scheme.keys(h[a:b]) if b > a else ():
                    keys.append(found)
                    doc.append(name)
                    spare.append(most)
            n = np.array([len(x) for x in keys[1:]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(doc, np.int64), n)), pa.array(_text.signed(np.concatenate(keys))), pa.array(np.repeat(np.array(spare, np.int32), n))], ["doc_id", "key", "spare"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, spare int")


def _tokens(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for ids, first, h, _ in _sets(batches, k):
            each = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            counts = [np.minimum(np.bincount((x >> _U(57)).astype(np.int64), minlength=BUCKETS), FULL).astype(np.uint8).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in each], pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "tokens", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens binary, counts binary")


def _histograms(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _highest(table: pa.Table) -> pa.Table:
    """A part's histogram: the highest count of any member in each bucket."""
    return pa.table({"g": table["group"][:1], "p": table["part"][:1], "highest": pa.array([_histograms(table["counts"]).max(axis=0).tobytes()], pa.binary())})


def _may_qualify(scheme: Scheme):
    def run(batches):
        """Asked parts of which some member may overlap enough: the overlap with each is at most
        the sum of the smaller counts of both histograms."""
        for batch in batches:
            if batch.num_rows:
                a, b = _histograms(batch["counts"]), _histograms(batch["highest"])
                n, least = batch["n"].to_numpy(), batch["least"].to_numpy()
                least = np.maximum(least, -(-n * scheme.num // scheme.den))
                enough = -(-scheme.num * (n + least) // (scheme.num + scheme.den))
                keep = (np.minimum(a, b).sum(axis=1, dtype=np.int64) >= enough) | ((a == FULL) & (b == FULL)).any(axis=1)
                yield batch.select(["doc_id", "g", "p"]).filter(pa.array(keep))

    return run


def _load(column) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in column.to_pylist()]


class _Group:
    """The members of a part: their shingles in one array, with owners, sorted by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        everything = np.concatenate([*sets, np.zeros(0, _U)])
        order = np.argsort(everything, kind="stable")
        self.token, self.owner = everything[order], np.repeat(np.arange(len(sets)), self.size)[order]
        self.union = np.unique(self.token)

    def common(self, tokens: np.ndarray) -> np.ndarray:
        """Overlap of a set with every member."""
        a, b = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        n = b - a
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
        return np.bincount(self.owner[at], minlength=len(self.size))


def _link_part(scheme: Scheme):
    def run(table):
        """Edges of a part: leaders are compared with all members; then every other member outside
        the part's largest component is, until all members are in one. A pair that is never
        compared is in one component by then."""
        table = table.sort_by("doc_id")
        ids, sets = table["doc_id"].to_numpy(), _load(table["tokens"])
        group, reached, u, v = _Group(sets), np.zeros(len(ids), bool), [], []
        component = np.arange(len(ids))

        def compare(i):
            hit = np.flatnonzero(scheme.linked(group.common(sets[i]), group.size[i], group.size))
            u.append(ids[hit])
            v.append(np.full(len(hit), ids[i]))
            component[np.isin(component, component[hit])] = component[i]
            return hit

        leaders = []
        for i in range(len(ids)):
            if not reached[i]:
                reached[compare(i)] = True
                leaders.append(i)
        main = component == np.bincount(component).argmax() if len(ids) else reached
        for i in np.setdiff1d(np.flatnonzero(~main), leaders):
            if (component != component[i]).any():
                compare(i)
        u, v = np.concatenate([*u, np.zeros(0, np.int64)]), np.concatenate([*v, np.zeros(0, np.int64)])
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return run


def _open_group(scheme: Scheme):
    def run(members, queries):
        """Edges between queries and a part's members, if the part's union qualifies."""
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if members.num_rows and queries.num_rows:
            ids, group = members["doc_id"].to_numpy(), _Group(_load(members["tokens"]))
            for q, tokens in zip(queries["doc_id"].to_pylist(), _load(queries["tokens"]), strict=True):
                if np.isin(tokens, group.union, assume_unique=True).sum() < scheme.least(len(tokens)):
                    continue
                hit = np.flatnonzero(scheme.linked(group.common(tokens), len(tokens), group.size))
                u.append(ids[hit])
                v.append(np.full(len(hit), q))
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return run


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("id").alias("doc_id"), "component")
    return rows.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, group_rows: int = 512) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, one row per row of docs.

    Words are runs outside white space with A-Z lower-cased. Two documents link when
    den * intersection >= num * union of their distinct k-word shingles; a document of fewer
    words has its whole sequence as one shingle, one without words or text (null, empty) has
    none and links with nothing. component_id is the smallest doc_id that links reach. Rows that
    share an id are one document to others (their links join); a null id links with nothing and
    has a null component_id. Other columns are ignored. An empty table gives no rows.
    """
    scheme = Scheme(num, den)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = _store.table(signatures(rows, k), "signatures")
    usable = sizes.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    copies = _store.table(usable.join(classes, ["n", "s1", "s2"]).filter("doc_id <> rep").select("doc_id", "rep"), "copies")
    same = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    rows = _store.with_ids(rows.filter("doc_id is not null"), copies.select("doc_id").distinct(), "doc_id", "left_anti")

    # One shuffle of the keys; equal sets are gone by then, and a document has many keys.
    posting = Window.partitionBy("key")
    shared = _postings(rows, k, scheme).withColumn("leader", F.min("doc_id").over(posting)).withColumn("other", F.max("doc_id").over(posting))
    shared = shared.withColumn("often", F.count("*").over(posting)).filter("leader <> other")
    # The rows of a repeated id spare nothing, as it isn't told which row a key comes from.
    repeated = _store.table(usable.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id", F.lit(True).alias("many")), "repeated")
    shared = shared.join(repeated, "doc_id", "left")
    commonest = Window.partitionBy("doc_id", "spare", F.when(F.col("many"), F.col("key"))).orderBy(F.desc("often"), F.desc("key"))
    seen = shared.withColumn("rank", F.row_number().over(commonest)).filter("many or rank > spare")
    seen = _store.table(seen.select("doc_id", "key", "leader"), "postings")
    groups = seen.groupBy("doc_id").agg(F.min("leader").alias("group"))
    parts = groups.groupBy("group").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = groups.join(parts.filter("part = 0").select("group", "parts"), "group").select("doc_id", "group", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("home"))
    placed = placed.union(parts.select(F.col("group").alias("doc_id"), "group", "part", F.lit(False)))
    placed = _store.table(placed.groupBy("doc_id", "group", "part").agg(F.max("home").alias("home")), "groups")
    tokens = _store.table(_tokens(_store.with_ids(rows, placed.select("doc_id").distinct(), "doc_id", "left_semi"), k), "tokens")

    inside = placed.drop("home").join(tokens.select("doc_id", "tokens"), "doc_id").groupBy("group", "part").applyInArrow(_link_part(scheme), "u long, v long")
    edges = _store.table(inside.union(same), "links")
    found = _store.table(components(edges), "components")

    # Keys whose documents are in several components: who may still open which part. A leader's
    # places in other parts don't matter here: each document of a key is in its own part.
    placed = placed.filter("home").drop("home")
    lengths = tokens.select("doc_id", (F.length("tokens") / 8).cast("long").alias("n")).distinct()
    state = _store.table(_with_components(placed, found).join(lengths, "doc_id"), "state")
    posted = seen.join(state, "doc_id")
    # Of two components one isn't the key's commonest: its documents ask, the others are asked.
    sizes_of = posted.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes_of.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1")
    posted = _store.table(posted.join(main.select("key", "main.component").withColumnRenamed("component", "main"), "key"), "unsettled")
    bounds = [f("component").alias(c) for f, c in ((F.min, "low"), (F.max, "high"))] + [f("n").alias(c) for f, c in ((F.min, "least"), (F.max, "most"))]
    targets = posted.groupBy("key", F.col("group").alias("g")).agg(*bounds)
    mixed = state.groupBy(F.col("group").alias("g"), F.col("part").alias("p")).agg(*bounds)
    fits = (F.col("least") * num <= F.col("n") * den) & (F.col("most") * den >= F.col("n") * num)
    fits = fits & ((F.col("low") != F.col("high")) | (F.col("component") != F.col("low")))
    asked = posted.filter("component <> main").join(targets, "key").filter(fits).select("doc_id", "group", "part", "component", "n", "g").distinct()
    asked = asked.join(mixed, "g").filter(fits & ~((F.col("group") == F.col("g")) & (F.col("part") == F.col("p"))))
    asked = asked.select("doc_id", "g", "p", "n", "least").distinct()
    highest = placed.join(tokens.select("doc_id", "counts"), "doc_id").groupBy("group", "part").applyInArrow(_highest, "g long, p int, highest binary")
    asked = asked.join(tokens.select("doc_id", "counts"), "doc_id").join(highest, ["g", "p"]).select("doc_id", "g", "p", "n", "least", "counts", "highest")
    asked = asked.mapInArrow(_may_qualify(scheme), "doc_id long, g long, p int").distinct()
    asked = _store.table(asked, "openings")
    if not asked.isEmpty():
        blocks = asked.groupBy("g", "p").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("blocks"))
        queries = asked.join(blocks, ["g", "p"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).join(tokens.select("doc_id", "tokens"), "doc_id").select("g", "p", "block", "doc_id", "tokens")
        wanted = queries.select(F.col("g").alias("group"), F.col("p").alias("part"), F.col("block").alias("for_block")).distinct()
        members = placed.join(wanted, ["group", "part"]).join(tokens, "doc_id").select("group", "part", "for_block", "doc_id", "tokens")
        across = members.groupBy("group", "part", "for_block").cogroup(queries.groupBy("g", "p", "block")).applyInArrow(_open_group(scheme), "u long, v long")
        more = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
        found = _store.table(components(across.union(more)), "components")
    out = sizes.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is their component's smallest, with all columns of docs; rows with
    a null id stay."""
    found = jaccard_components(docs, k, num, den)
    gone = _store.table(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return _store.with_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


#: DuckDB SQL for n_shingles and component_id of jaccard_components(k=3, num=90) on small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM s),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 90 <= b.n * 100 AND b.n * 90 <= a.n * 100 GROUP BY 1, 2),
l AS (SELECT u, v FROM o WHERE 100 * c >= 90 * (na + nb - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN m ON m.id = s.doc_id
"""
