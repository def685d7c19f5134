"""A persistent store of vectors: staged rows, sealed segments, a versioned manifest."""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import IndexOutOfBounds, InvalidHeader, InvalidVectorDimension, InvariantViolation, StorageError, TaskError, UnsupportedVersion
from ..operators import compaction, index, routing, search, segments
from ..operators.planes import Planes, make_planes
from .files import Files

FORMAT, VERSION = "lodestar-vectors", 1
_POST = "array<struct<mu: double, nu: double, sigma2: double, logc: double>>"
_STATS = "array<struct<n: double, mean: double, m2: double>>"
#: Schemas of the tables of a commit; all but ``segments`` are partitioned by segment_id.
SCHEMAS = {
    "segments": f"segment_id long, depth int, dim int, vector_count long, created_at_unix_s long, centroid array<double>, radius_sq double, mean_norm double, min_vals array<double>, max_vals array<double>, root_stats {_STATS}, root_post {_POST}",
    "codes": "row_id int, id long, codes array<smallint>, segment_id long",
    "postings": "table_id int, sig long, row_id int, segment_id long",
    "experts": f"table_id int, sig long, cnt long, stats {_STATS}, post {_POST}, segment_id long",
}


def _columns(schema: str) -> list[str]:
    """The parts of a schema string, one for each column."""
    return re.split(r", (?![^<]*>)", schema)


def _together(spark, *jobs):
    """Run jobs in threads of their own and give their results; the first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]
        for f in running:
            if f.exception() is not None:
                raise TaskError(f"sealing failed: {f.exception()}") from f.exception()
        return [f.result() for f in running]


class Neighbor(NamedTuple):
    """One result of a query."""

    id: int
    distance: float


class Neighbors(NamedTuple):
    """The results of a batch: ids (n, k), distances (n, k), and how many each query has (n). Beyond a query's count, id
    0 stands at distance infinity."""

    ids: np.ndarray
    distances: np.ndarray
    counts: np.ndarray


class VectorStore:
    """Rows (id, vector) in segments. One writer at a time; readers see what the manifest named when they began.

    Rows inserted are staged; full segments are sealed at once and the rest by ``flush``. Only sealed rows are
    searched, unless ``include_active`` is asked for. Ids may repeat: the nearest of an id's vectors counts.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.files = Files(spark, self.path)
        self.config = Config(**manifest["config"])
        self._planes: dict[str, Planes] = {}

    # -- creating and opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None) -> VectorStore:
        """A new store; an error if there is one at ``path``."""
        if Files(spark, path).list("manifest"):
            raise StorageError(f"{path} holds a store already")
        store = cls(spark, path, {"format": FORMAT, "format_version": VERSION, "version": 0, "config": (config or Config()).as_dict(), "next_segment_id": 0, "live": [], "configs": [], "staged": [], "consumed": 0, "lineage": {}, "streams": {}})
        store._commit()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> VectorStore:
        """The store at ``path``; with ``config``, later segments are sealed by it, and its dimension must be the store's."""
        manifest = cls._newest(spark, path)
        store = cls(spark, path, manifest)
        if config is not None:
            if config.dimension != store.config.dimension:
                raise InvalidVectorDimension(f"the store has dimension {store.config.dimension}")
            store.config = config
            manifest["config"] = config.as_dict()
        return store

    @staticmethod
    def _newest(spark: SparkSession, path: str) -> dict:
        files = Files(spark, path)
        if not files.exists():
            raise StorageError(f"{path} does not exist")
        versions = [n for n in files.list("manifest") if n.endswith(".json")]
        if not versions:
            raise StorageError(f"{path} holds no store")
        try:
            manifest = json.loads(files.read("manifest", versions[-1]))
        except ValueError as e:
            raise InvalidHeader(f"{path}: the manifest can't be read") from e
        if manifest.get("format") != FORMAT:
            raise InvalidHeader(f"{path}: not a manifest of a store")
        if manifest["format_version"] > VERSION:
            raise UnsupportedVersion(f"{path}: format {manifest['format_version']}")
        live = {s["segment_id"] for s in manifest["live"]}
        if len(live) < len(manifest["live"]) or any(k >= manifest["next_segment_id"] for k in live):
            raise InvariantViolation(f"{path}: the manifest names a segment twice, or one that was never allotted")
        return manifest

    def reload(self) -> None:
        """Go back to the newest committed state, after an error."""
        self.manifest = self._newest(self.spark, self.path)

    def _commit(self) -> None:
        self.manifest["version"] += 1
        self.files.put_new(json.dumps(self.manifest), "manifest", f"{self.manifest['version']:010d}.json")

    # -- writing

    def insert(self, rows: DataFrame) -> None:
        """Stage ``rows(id, vector)``: all of them, or an error and none."""
        name = f"staging/{uuid.uuid4().hex}"
        own = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.monotonically_increasing_id().alias("ord"))
        own.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema("id long, vector array<float>, ord long").parquet(f"{self.path}/{name}")
        bad = F.col("vector").isNull() | F.col("id").isNull() | (F.size("vector") != self.config.dimension) | F.exists(F.coalesce("vector", F.array()), lambda x: x.isNull())
        n, wrong = written.agg(F.count("*"), F.count(F.when(bad, 1))).first()
        if wrong:
            self.files.delete(name)
            raise InvalidVectorDimension(f"{wrong} of {n} rows have no id or not {self.config.dimension} entries")
        if n:
            self.manifest["staged"].append([name, n])
            self._commit()
            self._seal(whole_only=True)

    def insert_batch(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Stage the rows of a (n, dimension) array."""
        if len(vectors) != len(ids):
            raise ValueError("there must be as many ids as vectors")
        self.insert(self.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "id long, vector array<float>"))

    def staged_rows(self) -> DataFrame:
        """(id, vector, at): staged rows that aren't sealed yet, numbered by arrival."""
        parts, start, schema = [], 0, "id long, vector array<float>, ord long"
        for name, n in self.manifest["staged"]:
            rows = segments.ordinals(self.spark.read.schema(schema).parquet(f"{self.path}/{name}"))
            parts.append(rows.select("id", "vector", (F.col("at") + start - self.manifest["consumed"]).alias("at")))
            start += n
        if not parts:
            return self.spark.createDataFrame([], "id long, vector array<float>, at long")
        return reduce(DataFrame.unionByName, parts).where("at >= 0")

    def _seal(self, whole_only: bool) -> None:
        capacity = self.config.max_active_vectors
        n = sum(n for _, n in self.manifest["staged"]) - self.manifest["consumed"]
        take = n // capacity * capacity if whole_only else n
        if take <= 0:
            return
        rows = segments.assign_segments(self.staged_rows().where(F.col("at") < take), capacity, self.manifest["next_segment_id"])
        count = -(-take // capacity)
        first = self.manifest["next_segment_id"]
        self._write_segments(rows.select("segment_id", "row_id", "id", "vector"), {first + i: 0 for i in range(count)})
        self.manifest["next_segment_id"] += count
        done = self.manifest["consumed"] + take
        gone = []
        while self.manifest["staged"] and self.manifest["staged"][0][1] <= done:
            name, size = self.manifest["staged"].pop(0)
            gone.append(name)
            done -= size
        self.manifest["consumed"] = done
        self._commit()
        for name in gone:
            self.files.delete(name)

    def _write_segments(self, rows: DataFrame, depths: dict[int, int]) -> None:
        """Seal ``rows(segment_id, row_id, id, vector)`` as one commit and name it in the manifest, not yet committed."""
        name = uuid.uuid4().hex
        at = f"{self.path}/tmp/{name}"
        read = lambda table, schema: self.spark.read.schema(schema).parquet(f"{at}/{table}")
        keep = lambda df, table: df.repartition("segment_id").sortWithinPartitions("segment_id", *[c for c in ("table_id", "sig") if c in df.columns]).write.partitionBy("segment_id").parquet(f"{self.path}/data/{table}/commit={name}")
        planes = self._planes_for(self.config)

        def put(df: DataFrame, table: str) -> DataFrame:
            df.write.parquet(f"{at}/{table}")
            return read(table, df.schema)

        rows = put(rows, "_rows")
        # what doesn't depend on each other runs side by side
        hashed = lambda: put(index.hashed(rows, planes, ["segment_id", "row_id"]), "_hashed")
        stats = lambda: put(segments.segment_stats(rows), "_stats")
        hashed, stats = _together(self.spark, hashed, stats)
        coded = put(segments.encode_rows(rows, stats), "_coded")
        dims = planes.expert.shape[1]
        tables = index.by_table(hashed, ["segment_id", "row_id"], dims)
        depth = F.lit(0)
        for k, v in depths.items():
            depth = F.when(F.col("segment_id") == k, v).otherwise(depth) if v else depth
        full = segments.with_posteriors(stats.join(segments.radius(coded), "segment_id"))
        full = full.withColumns({"depth": depth.cast("int"), "dim": F.lit(self.config.dimension), "created_at_unix_s": F.lit(int(time.time())).cast("long")})
        full = full.select([c.split(" ")[0] for c in _columns(SCHEMAS["segments"])])
        _together(
            self.spark,
            lambda: keep(coded.drop("off"), "codes"),
            lambda: keep(index.postings(tables), "postings"),
            lambda: keep(index.experts(tables, dims), "experts"),
            lambda: full.write.parquet(f"{self.path}/data/segments/commit={name}"),
        )
        self.files.delete("tmp")
        own = self.config.as_dict()
        if own not in self.manifest["configs"]:
            self.manifest["configs"].append(own)
        self.manifest["live"] += [{"segment_id": k, "depth": v, "data": name, "config": self.manifest["configs"].index(own)} for k, v in depths.items()]

    def flush(self) -> None:
        """Seal all staged rows, then merge segments as long as any two should be. The gains of pairs are kept from merge
        to merge: each adds those with the new segment only."""
        self._seal(whole_only=False)
        gains = None
        while self._due():
            gains = self._gains(gains)
            if not self._merge(gains):
                break
        self.files.delete("gains")

    def save(self) -> None:
        """Flush, and drop data and manifests that no reader of the newest one needs."""
        self.flush()
        used = {f"commit={s['data']}" for s in self.manifest["live"]}
        for table in SCHEMAS:
            for name in self.files.list("data", table):
                if name not in used:
                    self.files.delete("data", table, name)
        for name in self.files.list("manifest")[:-1]:
            self.files.delete("manifest", name)

    def compact_once(self) -> bool:
        """Merge the best pair if there are enough segments and a pair gains; whether it did."""
        return self._due() and self._merge(compaction.pair_gains(self.table("segments"), self.config.compaction_depth_cap))

    def _due(self) -> bool:
        return len(self.manifest["live"]) >= self.config.compaction_trigger

    def _gains(self, before: DataFrame | None) -> DataFrame:
        """The gains of all pairs of live segments, stored; ``before``: those before the last merge."""
        own, cap = self.table("segments"), self.config.compaction_depth_cap
        if before is None:
            found = compaction.pair_gains(own, cap)
        else:
            ids = own.select("segment_id")
            left, right = (F.broadcast(ids.withColumnRenamed("segment_id", c)) for c in ("left_id", "right_id"))
            found = before.join(left, "left_id", "left_semi").join(right, "right_id", "left_semi").select(before.columns)
            found = found.unionByName(compaction.pair_gains(own, cap, self.manifest["next_segment_id"] - 1))
        at = f"{self.path}/gains/{uuid.uuid4().hex}"
        found.write.parquet(at)
        return self.spark.read.schema(found.schema).parquet(at)

    def _merge(self, gains: DataFrame) -> bool:
        pair = compaction.best_of(gains).first()
        if pair is None:
            return False
        left, right, new = pair.left_id, pair.right_id, self.manifest["next_segment_id"]
        depth = 1 + max(s["depth"] for s in self.manifest["live"] if s["segment_id"] in (left, right))
        self._write_segments(compaction.merged_rows(self.table("codes"), self.table("segments"), left, right, new), {new: depth})
        self.manifest["live"] = [s for s in self.manifest["live"] if s["segment_id"] not in (left, right)]
        self.manifest["lineage"] |= {str(left): new, str(right): new}
        self.manifest["next_segment_id"] += 1
        self._commit()
        return True

    # -- reading

    def _planes_for(self, config: Config) -> Planes:
        return self._planes.setdefault(config.planes_key, make_planes(config))

    def table(self, name: str, live: list[dict] | None = None) -> DataFrame:
        """A table of the live segments; what partition it needs is pruned by segment_id."""
        live = self.manifest["live"] if live is None else live
        if not live:
            return self.spark.createDataFrame([], SCHEMAS[name])
        base = f"{self.path}/data/{name}"
        paths = sorted({f"{base}/commit={s['data']}" for s in live})
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, commit string").option("basePath", base).parquet(*paths).drop("commit")
        ids = [s["segment_id"] for s in live]
        if len(ids) <= search.PRUNED:
            return rows.where(F.col("segment_id").isin(ids))
        own = self.spark.createDataFrame(pd.DataFrame({"segment_id": np.array(ids, np.int64)}))
        return rows.join(F.broadcast(own), "segment_id", "left_semi").select(*[c.split(" ")[0] for c in _columns(SCHEMAS[name])])

    def num_sealed_segments(self) -> int:
        return len(self.manifest["live"])

    def sealed_segment_summaries(self) -> DataFrame:
        """(segment_id, depth, vector_count, created_at_unix_s, query_visits, centroid, radius_sq, mean_norm)."""
        return self._with_visits(self.table("segments")).select("segment_id", "depth", "vector_count", "created_at_unix_s", "query_visits", "centroid", "radius_sq", "mean_norm")

    def visits(self) -> DataFrame:
        """(segment_id, query_visits): visits of live segments, with those of the segments merged into them."""
        if not self.files.list("visits"):
            return self.spark.createDataFrame([], "segment_id long, query_visits long")
        heir = dict(self.manifest["lineage"])
        final = {}
        for k in heir:
            at = int(k)
            while str(at) in heir:
                at = heir[str(at)]
            final[int(k)] = at
        rows = self.spark.read.schema("segment_id long, n long").parquet(f"{self.path}/visits")
        if final:
            names = self.spark.createDataFrame(list(final.items()), "segment_id long, heir long")
            rows = rows.join(names, "segment_id", "left").select(F.coalesce("heir", "segment_id").alias("segment_id"), "n")
        return rows.groupBy("segment_id").agg(F.sum("n").alias("query_visits"))

    def _with_visits(self, own: DataFrame) -> DataFrame:
        return own.join(self.visits(), "segment_id", "left").withColumn("query_visits", F.coalesce("query_visits", F.lit(0).cast("long")))

    def search(self, queries: DataFrame, k: int, metric="adc", threshold: float | None = None, delta: float | None = None, include_active: bool = False, record_visits: bool = False) -> DataFrame:
        """(query_id, rank, id, distance) for ``queries(query_id, vector)``: routed at once, then one lazy plan for the batch.

        ``metric``: ``adc``, ``l2``, ``cosine``, ``dot``, or a function of two matrices; ``delta`` None takes the
        configuration's. ``include_active`` also compares staged rows, exactly. A query of another length has no
        result. ``record_visits`` runs a job that counts one visit for each selected segment of a query with a result.
        """
        delta = self.config.delta if delta is None else delta
        queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        found, selected = [], []
        for n in sorted({s["config"] for s in self.manifest["live"]}) if k > 0 else ():
            config = Config(**self.manifest["configs"][n])
            live = [s for s in self.manifest["live"] if s["config"] == n]
            tables = {t: self.table(t, live) for t in SCHEMAS}
            chosen, plan = search.ann_candidates(queries, tables["segments"], tables["experts"], tables["postings"], self._planes_for(config), config, delta)
            found.append(search.rerank(chosen, tables["codes"], tables["segments"], queries, metric, plan, config.lsh_max_candidates))
            selected.append(plan.selected)
        if include_active and k > 0:
            plain = "l2" if metric == "adc" else metric
            found.append(search.exact_knn(self.staged_rows(), queries, k, plain, threshold).select("query_id", "id", "distance"))
        if not found:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, distance double")
        out = search.finish(reduce(DataFrame.unionByName, found), k, threshold)
        if record_visits and selected:
            with_result = out.select("query_id").distinct()
            seen = reduce(DataFrame.unionByName, selected).join(with_result, "query_id", "left_semi")
            seen.groupBy("segment_id").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{self.path}/visits")
        return out

    def query(self, vector, k: int, metric="adc", threshold: float | None = None, delta: float | None = None) -> list[Neighbor]:
        """The k nearest of one vector, nearest first; counts the visit."""
        if len(vector) != self.config.dimension:
            raise InvalidVectorDimension(f"the store has dimension {self.config.dimension}")
        rows = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")
        return [Neighbor(r.id, r.distance) for r in self.search(rows, k, metric, threshold, delta, record_visits=True).orderBy("rank").collect()]

    def query_batch(self, vectors: np.ndarray, k: int, metric="adc", threshold: float | None = None, delta: float | None = None) -> Neighbors:
        """The k nearest of each row of an (n, dimension) array; counts the visits of each."""
        rows = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, vector array<double>")
        ids, distances, counts = np.zeros((len(vectors), k), np.int64), np.full((len(vectors), k), np.inf), np.zeros(len(vectors), np.int64)
        for r in self.search(rows, k, metric, threshold, delta, record_visits=True).collect():
            ids[r.query_id, r.rank - 1], distances[r.query_id, r.rank - 1] = r.id, r.distance
            counts[r.query_id] += 1
        return Neighbors(ids, distances, counts)

    def external_id(self, segment_id: int, row_id: int) -> int:
        """The id of a sealed row."""
        wanted = self.spark.createDataFrame([(segment_id, row_id)], "segment_id long, row_id int")
        found = segments.external_ids(self.table("codes").where(F.col("segment_id") == segment_id), wanted).first().id
        if found is None:
            raise IndexOutOfBounds(f"segment {segment_id} has no row {row_id}")
        return found

    def explain_query_routing(self, queries: DataFrame, delta: float | None = None) -> DataFrame:
        """How each of ``queries(query_id, vector)`` would be routed; counts no visit."""
        return routing.explain_routing(routing.root_scores(queries, self.table("segments")), self.config.delta if delta is None else delta)

    def explain_next_compaction(self, with_drift: bool = True) -> DataFrame:
        """What merging the best pair would do: one row, or none. With the drift, the merge is tried out, not written."""
        own = self._with_visits(self.table("segments"))
        pair = compaction.best_pair(own, self.config.compaction_depth_cap)
        out = compaction.report(own, pair, self.config.dimension)
        if not with_drift:
            return out
        best = pair.first()
        if best is None:
            return out.withColumn("drift", F.lit(None).cast("double"))
        before = compaction.merged_rows(self.table("codes"), own, best.left_id, best.right_id, -1)
        stats = segments.segment_stats(before)
        after = segments.decode_rows(segments.encode_rows(before, stats), stats)
        return out.join(F.broadcast(compaction.drift(before, after)))

    def __repr__(self) -> str:
        c = self.config
        return f"VectorStore(path={self.path!r}, dimension={c.dimension}, lsh_tables={c.lsh_num_tables}, lsh_bits={c.lsh_bits_per_table}, segments={self.num_sealed_segments()})"
