"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a penalty for crowded clusters. A
vector goes to the list of its nearest centroid and, if it lies near a boundary, to further
lists whose distance is within `NEAR` times the smallest, unless a list it already has lies
closer to that list than `APART` times the vector's own distance. A query walks a neighbour graph of the centroids in
memory and takes every list whose distance is within `REACH` times the nearest one's, and
more until the taken lists are the first choice of over k vectors.

Nearness is the inner product: vectors get one more component that makes all lengths equal
(queries get 0), which turns the largest product into the smallest distance. Lists and the
queries on them are cut into blocks of bounded size, so a list that holds a third of all
vectors is many groups; in each block products are exact and the k best, with all that tie
within rounding, go on to the ranking of each query. A query's nearest lists, with `EARLY`
vectors together, are read first; of all further lists only vectors that reach the k-th best
score found there go on. Scores are double precision sums over
the original components. The number of centroids grows with the vectors up to an eighth of
`SAMPLE`; centroids and list counts, which are sent to every task, are bounded by it.

Null ids and vectors that are null, empty, zero or hold nulls or non-finite components take
no part. Vectors of one length are searched among themselves: each length with over `BLOCK`
vectors by an index of its own, all others exactly, block by block. Every row is a candidate
and, if asked for, a query of its own, whatever rows share its id; only the row itself is
left out. Ties go to the smaller id. Queries without candidates have no rows; an empty table
gives an empty result. Other columns are not looked at.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.llm.common import ship, stored, table

K = 20
EVERY = 20
SAMPLE = 20_000
LIST_SIZE = 200
NEAR = 1.1
COPIES = 4
APART = 0.5
CANDIDATES = 8
REACH = 1.15
LINKS = 24
BEAM = 96
EARLY = 1_000
BLOCK = 2_048
ROUNDS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """(r, vec_id, embedding array<double>, width) of the rows that take part; `r` numbers them."""
    clean = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(clean, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.monotonically_increasing_id().alias("r"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("width"))
    return stored(rows, "vectors")


class Index:
    """Centroids (augmented), their neighbour graph, and how many vectors choose each first."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, seed: int = 11):
        self.longest = longest
        points = self.augment(sample)
        rng = np.random.default_rng(seed)
        centres = points[rng.choice(len(points), size=min(lists, len(points)), replace=False)].copy()
        target = len(points) / len(centres)
        for _ in range(ROUNDS):
            # penalty in the measure of a typical distance, growing with what a cluster already has
            sizes, where = np.zeros(len(centres)), np.empty(len(points), dtype=np.int64)
            spread = None
            for block in np.array_split(rng.permutation(len(points)), max(1, len(points) // 256)):
                d = self.squares(points[block], centres)
                spread = float(np.median(d.min(axis=1))) if spread is None else spread
                where[block] = (d + 0.05 * spread * sizes / target).argmin(axis=1)
                sizes += np.bincount(where[block], minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, where, points)
            full = sizes > 0
            centres[full] = sums[full] / sizes[full, None]
        self.centres = centres
        m = len(centres)
        order = np.argsort(self.squares(centres, centres), axis=1, kind="stable")[:, 1 : LINKS + 1]
        graph = [set(row.tolist()) for row in order]
        for a, row in enumerate(order):  # both ways, and a ring, so that every list can be reached
            for b in row:
                graph[b].add(a)
            graph[a].add((a + 1) % m)
            graph[(a + 1) % m].add(a)
        self.graph = [np.array(sorted(g - {a}), dtype=np.int64) for a, g in enumerate(graph)]
        self.entries = np.unique(np.linspace(0, m - 1, min(m, 16)).astype(np.int64))
        self.first = np.zeros(m, dtype=np.int64)

    def augment(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (vectors * vectors).sum(axis=1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    @staticmethod
    def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)

    def assign(self, vectors: np.ndarray) -> list[list[int]]:
        """Lists of each vector, the nearest first."""
        points = self.augment(vectors)
        out: list[list[int]] = []
        for part in np.array_split(points, max(1, len(points) // 1024)):
            d = np.sqrt(self.squares(part, self.centres))
            near = np.argsort(d, axis=1, kind="stable")[:, :CANDIDATES]
            d = np.take_along_axis(d, near, axis=1)
            places = self.centres[near]
            taken = np.zeros(near.shape, dtype=bool)
            taken[:, 0] = True
            for j in range(1, near.shape[1]):
                between = np.linalg.norm(places - places[:, j : j + 1], axis=2)
                apart = (~taken | (between > APART * d[:, j : j + 1])).all(axis=1)
                taken[:, j] = apart & (d[:, j] <= NEAR * d[:, 0]) & (taken.sum(axis=1) < COPIES)
            out += [row[t].tolist() for row, t in zip(near, taken)]
        return out

    def walk(self, query: np.ndarray, beam: int = BEAM) -> list[tuple[float, int]]:
        """(distance, list) of the lists found near a query, by best-first search of the graph."""
        point = np.append(query, 0.0)
        away = lambda at: np.sqrt(((self.centres[at] - point) ** 2).sum(axis=1))
        seen = set(self.entries.tolist())
        todo = [(d, int(c)) for d, c in zip(away(self.entries), self.entries)]
        heapq.heapify(todo)
        best = [(-d, c) for d, c in todo]
        heapq.heapify(best)
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = [x for x in self.graph[c].tolist() if x not in seen]
            seen.update(new)
            for e, x in zip(away(np.array(new, dtype=np.int64)) if new else (), new):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(todo, (e, x))
                    heapq.heappush(best, (-e, x))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, c) for d, c in best)

    def early(self, lists: list[int]) -> int:
        """How many of a query's lists, nearest first, hold `EARLY` vectors together."""
        return int(np.searchsorted(np.cumsum(self.first[lists]), EARLY)) + 1

    def probes(self, query: np.ndarray, k: int) -> list[int]:
        beam = BEAM
        while True:
            found, held, out = self.walk(query, beam), 0, []
            for d, c in found:
                if held > k and d > REACH * found[0][0]:
                    return out
                out.append(c)
                held += int(self.first[c])
            if len(found) >= len(self.centres):
                return out
            beam *= 2  # all that was found is within reach: look further


def fit(rows: DataFrame, n: int, longest: float) -> Index:
    """An index of `n` vectors of one length, fitted on at most SAMPLE of them chosen by a hash of their ids."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "r").limit(SAMPLE).select("embedding").toArrow()
    points = np.array(sample["embedding"].to_pylist(), dtype=float)
    return Index(points, longest, int(np.clip(n // LIST_SIZE, 1, max(1, len(points) // 8))))


def _numbered(column: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks)


RESULT = "qr long, query_id long, r long, vec_id long, score double"


def _best(k: int, longest: float):
    """The k best of a block of vectors for each of a block of queries, and all that tie with them within rounding.

    Queries may bring a score, `bound`, that theirs must reach.
    """

    def best(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["qr", "query_id", "r", "vec_id", "score"]
        out = [pd.DataFrame({n: [] for n in names}).astype(dict.fromkeys(names[:-1], "int64"))]
        if len(have) and len(ask):
            vectors, ids, rows = np.stack(have["embedding"].to_numpy()), have["vec_id"].to_numpy(), have["r"].to_numpy()
            for at in range(0, len(ask), 256):
                part = ask.iloc[at : at + 256]
                points, asking, own = np.stack(part["embedding"].to_numpy()), part["query_id"].to_numpy(), part["qr"].to_numpy()
                rough = points @ vectors.T
                rough[own[:, None] == rows[None, :]] = -np.inf
                n = min(k, rough.shape[1])
                least = np.partition(rough, rough.shape[1] - n, axis=1)[:, -n]
                if "bound" in part:
                    least = np.maximum(least, part["bound"].to_numpy())
                slack = 1e-9 * np.linalg.norm(points, axis=1) * longest
                q, v = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
                exact = (vectors[v] * points[q]).sum(axis=1)
                order = np.lexsort((rows[v], ids[v], -exact, q))
                q, v, exact = q[order], v[order], exact[order]
                first = np.searchsorted(q, q)  # where each query's rows begin
                kept = np.arange(len(q)) - first < k
                q, v = q[kept], v[kept]
                out.append(pd.DataFrame({"qr": own[q], "query_id": asking[q], "r": rows[v], "vec_id": ids[v], "score": exact[kept]}))
        return pd.concat(out)

    return best


def _meet(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, k: int, longest: float) -> DataFrame:
    """Products of vectors and queries with one key, in blocks; `sizes` has the blocks of both (key, nv, nq), a bounded number of rows."""
    sizes = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.join(sizes, key).select(key, _numbered(F.col("r"), F.col("nv")).cast("int").alias("v"), every(F.col("nq")).alias("q"), "r", "vec_id", "embedding")
    asking = [c for c in right.columns if c != key]
    right = right.join(sizes, key).select(key, every(F.col("nv")).alias("v"), _numbered(F.col("qr"), F.col("nq")).cast("int").alias("q"), *asking)
    return left.groupBy(key, "v", "q").cogroup(right.groupBy(key, "v", "q")).applyInPandas(_best(k, longest), RESULT)


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _few(rows: DataFrame, queries: Column, k: int, longest: float) -> DataFrame:
    """All vectors of each length against all queries of that length."""
    asked = rows.where(queries).toDF("qr", "query_id", "embedding", "asked_width")
    # at most BLOCK vectors of a length, so each length is one block
    return rows.groupBy("width").cogroup(asked.groupBy("asked_width")).applyInPandas(_best(k, longest), RESULT)


def _indexed(rows: DataFrame, queries: Column, k: int, n: int, longest: float) -> DataFrame:
    """Vectors of one length through an index."""
    spark = rows.sparkSession
    index = fit(rows, n, longest)
    model = spark.sparkContext.broadcast(index)

    def post(parts):
        for pdf in parts:
            if len(pdf):
                lists = model.value.assign(np.stack(pdf["embedding"].to_numpy()))
                yield pd.DataFrame({"r": pdf["r"], "vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "lists": lists})

    postings = rows.select("r", "vec_id", "embedding").mapInPandas(post, "r long, vec_id long, embedding array<double>, lists array<int>")
    postings = stored(postings.select("r", "vec_id", "embedding", F.col("lists")[0].alias("home"), F.explode("lists").alias("list")), "postings")
    # one row per list
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"), F.count(F.when(F.col("home") == F.col("list"), 1)).alias("first")).collect()
    for s in sizes:
        index.first[s["list"]] = s["first"]
    model = spark.sparkContext.broadcast(index)

    def probe(parts):
        for pdf in parts:
            if len(pdf):
                lists = [model.value.probes(np.asarray(v), k) for v in pdf["embedding"]]
                early = [model.value.early(found) for found in lists]
                yield pd.DataFrame({"qr": pdf["qr"], "query_id": pdf["query_id"], "embedding": pdf["embedding"], "lists": lists, "early": early})

    asked = rows.where(queries).select(F.col("r").alias("qr"), F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.mapInPandas(probe, "qr long, query_id long, embedding array<double>, lists array<int>, early int")
    asked = asked.select("qr", "query_id", "embedding", "early", F.posexplode("lists").alias("at", "list"))
    asked = stored(asked.select("qr", "query_id", "embedding", "list", (F.col("at") < F.col("early")).alias("early")), "probes")
    lists = spark.createDataFrame([(s["list"], s["n"]) for s in sizes], "list int, n long").select("list", _blocks(F.col("n")).alias("nv"))
    lists = lists.join(asked.groupBy("list").agg(F.count("*").alias("n")).select("list", _blocks(F.col("n")).alias("nq")), "list")
    first = stored(_meet(postings, asked.where("early").drop("early"), lists, "list", k, longest), "early-found")
    place = F.row_number().over(Window.partitionBy("qr").orderBy(F.desc("score"), "vec_id", "r"))
    bound = first.dropDuplicates(["qr", "r"]).withColumn("place", place).where(F.col("place") == k).select("qr", F.col("score").alias("bound"))
    later = asked.where(~F.col("early")).drop("early").join(bound, "qr", "left").fillna(float("-inf"), "bound")
    return first.unionByName(_meet(postings, later, lists, "list", k, longest))


def search(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector for which `queries` holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("s"))
    large = widths.where(F.col("n") > BLOCK).orderBy("width").collect()
    small = rows.join(widths.where(F.col("n") <= BLOCK).select("width"), "width", "left_semi").select("r", "vec_id", "embedding", "width")
    longest = widths.agg(F.coalesce(F.max("s"), F.lit(0.0))).first()[0] ** 0.5
    found = _few(small, queries, k, longest)
    for w in large:
        found = found.unionByName(_indexed(rows.where(F.col("width") == w["width"]), queries, k, w["n"], w["s"] ** 0.5))
    found = found.dropDuplicates(["qr", "r"])  # a vector of several lists has one score
    rank = Window.partitionBy("qr").orderBy(F.desc("score"), "vec_id", "r")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
