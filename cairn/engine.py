"""One source tree under one engine: build, search, status, changes and generations."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.config import Config, project_id
from cairn.functions import paths as P
from cairn.operators import graph, guards, merge, scan, search, state
from cairn.operators.materialise import materialise
from cairn.sources import files as trees
from cairn.sources import live
from cairn.sources.generations import Store
from cairn.streaming.maintenance import Maintenance

# States, and bounds of what is shown and asked.
LIFECYCLE = ("dormant", "disabled", "warming", "ready", "failed")
SHOWN_PATHS, STALE_ROWS, STALE_TERMS = 64, 3, 40
MAX_QUERY, MAX_LIMIT = 512, 20


class Engine:
    """``search`` works at once: by the index where it stands, else by a bounded scan of the tree."""

    def __init__(self, spark: SparkSession, root: str, state_folder: str, config: Config | None = None, use_git: bool = True):
        self.spark, self.root, self.config, self.use_git = spark, root, config or Config(), use_git
        self.store = Store(spark, state_folder, self.config.generationRetention, self.config.quotaBytes)
        self.lifecycle = "dormant" if self.config.enabled else "disabled"
        self.telemetry: Counter = Counter()
        self.failures: list[str] = []
        self.index: search.Index | None = None
        self.indexed: DataFrame | None = None
        self.overlay: DataFrame | None = None
        self.pending: list[str] = []
        self.freshness, self.generation, self.head = "stale", 0, "no-head"
        self.content, self.content_version = None, 0
        excluded = P.excludes(self.config.excludePatterns)
        self.maintenance = Maintenance(self._notices, lambda path: bool(path) and not excluded(path), self.config.debounceMs)

    def _timed(self, name: str, work):
        start = time.monotonic()
        try:
            return work()
        finally:
            self.telemetry[f"{name}Count"] += 1
            self.telemetry[f"{name}DurationMsTotal"] += int(1000 * (time.monotonic() - start))

    # Building.

    def start(self) -> Engine:
        """Takes over the active generation if it was built the same way from the same clean head, else builds."""
        if self.lifecycle == "disabled":
            return self
        self.lifecycle = "warming"
        try:
            active = self.store.active()
            head = trees.git_head(self.root) if self.use_git else "no-head"
            clean = self.use_git and head != "no-head" and not trees.git_status(self.root)
            if active and clean and active["head"] == f"{head}/{self.config.build_key()}" and active["freshness"] == "fresh":
                self._timed("hydration", lambda: self._serve(self.store.load()))
                self.telemetry["hydratedFastReuseCount"] += 1
                self.freshness, self.generation, self.head = "fresh", active["generation"], head
            else:
                self.rebuild()
            self.lifecycle = "ready"
        except Exception as e:
            self.lifecycle = "failed"
            self.failures.append(type(e).__name__)
            raise
        return self

    def rebuild(self) -> int:
        """A full build; files that can't be read keep their earlier row.  Nothing changes unless all of it works."""
        found = materialise(self._timed("fullBuild", lambda: trees.build(self.spark, self.root, self.config.excludePatterns, self.use_git)))
        now = trees.file_table(found)
        failed = found.where("outcome = 'read-error'").select("path")
        if self.index is not None:
            now = now.unionByName(self.index.files.join(failed, "path", "left_semi"))
        now = materialise(now)
        head = trees.git_head(self.root) if self.use_git else "no-head"
        dirty = trees.git_status(self.root) if self.use_git else []
        listed = self.spark.createDataFrame(dirty, "path string, tracked boolean")
        listed = listed.join(now.select("path", F.col("contentHash").alias("hash")), "path", "left")
        overlay = materialise(state.reconcile(self.spark.createDataFrame([], "path string, hash string"), listed, failed))
        self.pending = [r["path"] for r in failed.orderBy("path").limit(SHOWN_PATHS + 1).collect()]
        facts = now.agg(F.count_if(F.col("degradedReason").isNotNull()).alias("d")).crossJoin(overlay.agg(F.count("*").alias("o")))
        self.freshness = facts.select(state.freshness(0, len(self.pending), 0, 0, F.col("d"), F.col("o"))).first()[0]
        self.generation = self._timed("generationWrite", lambda: self.store.activate(now, f"{head}/{self.config.build_key()}", self.freshness))
        self.head, self.overlay, self.indexed = head, overlay, found
        self._serve(now)
        return self.generation

    def _serve(self, files: DataFrame) -> None:
        """Serves ``files``; where their content is what is served already, the index and its version stand."""
        content = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), *files.columns)).alias("x")).first()
        if self.index is not None and content == self.content:
            return
        self.index = self._timed("searchIndexBuild", lambda: search.build_index(files))
        self.content, self.content_version = content, self.content_version + 1

    def apply(self, changes: DataFrame) -> None:
        """Changes (path, event, seq): the newest of each path is read again, or removed; other files stay as they are."""
        last = state.last_events(changes, ["seq"])
        gone = last.where("event = 'unlink'").select("path")
        touched = last.where("event <> 'unlink'").select("path")
        contents = trees.admitted(trees.tree(self.spark, self.root), self.config.excludePatterns).join(touched, "path", "left_semi")
        fresh = materialise(trees.file_table(trees.index_files(contents)))
        rest = self.index.files.join(last.select("path"), "path", "left_anti")
        now = materialise(rest.unionByName(fresh))
        before = self.index.files.select("path", "contentHash")
        entries = now.select("path", F.col("contentHash").alias("hash")).join(before, ["path"], "left").where(~F.col("hash").eqNullSafe(F.col("contentHash"))).select("path", "hash")
        removed = gone.join(before, "path", "left_semi").select("path", F.lit(state.DELETED).alias("hash"))
        added = entries.unionByName(removed)
        self.overlay = materialise(added if self.overlay is None else self.overlay.join(last.select("path"), "path", "left_anti").unionByName(added))
        self.telemetry["filesReindexed"] += fresh.count()
        self.freshness = "dirty" if self.overlay.limit(1).count() else self.freshness
        self._serve(now)

    def notify(self, event: str, path: str) -> None:
        """Takes note of a change; ``maintenance.tick`` or ``flush`` works on it."""
        if self.maintenance.notify(event, path):
            self.freshness = "stale"

    def flush(self) -> None:
        """Works on what was noted, within the bounds of a drain; what is left stays pending."""
        self.maintenance.drain()

    def _notices(self, updates: list[tuple[str, str, int]]) -> None:
        self.apply(self.spark.createDataFrame(updates, "path string, event string, seq long"))
        if self.maintenance.queue:
            self.freshness = "stale"
        elif not self.pending:
            self.freshness = "dirty" if self.overlay.limit(1).count() else "fresh"

    # Asking.

    def search(self, query: str, limit: int = 10, mode: str = "auto") -> DataFrame:
        """``path, score, kind, matchedSymbols, matchReasons`` of the best files."""
        if not 1 <= len(query) <= MAX_QUERY or not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"a query has 1 to {MAX_QUERY} characters and a limit of 1 to {MAX_LIMIT}")
        self.telemetry["searchAttemptCount"] += 1
        columns = ["path", "score", "kind", "matchedSymbols", "matchReasons"]
        if mode == "index" or (mode == "auto" and self.index is not None):
            with self.maintenance.lease():
                return self._timed("repoMapQuery", lambda: search.search(self.index, query, limit).select(*columns))
        self.telemetry["lexicalFallbackAttemptCount"] += 1
        found = self.scan(query, limit)
        reason = F.concat(F.lit("direct lexical fallback: "), F.col("coverage").cast("string"), F.when(F.col("coverage") == 1, " query term").otherwise(" query terms"))
        none = F.array().cast("array<string>")
        return found.results.select("path", F.col("score").cast("double").alias("score"), F.lit("lexical").alias("kind"), none.alias("matchedSymbols"), F.array(reason).alias("matchReasons"))

    def scan(self, query: str, limit: int = 20, limits: scan.Limits = scan.Limits()) -> scan.Scan:
        listing = trees.git_files(self.root) if self.use_git else None
        contents = trees.admitted(trees.tree(self.spark, self.root), self.config.excludePatterns, trees.ignore_lines(self.spark, self.root) if listing is None else (), listing)
        texts = contents.select("path", F.decode("content", "UTF-8").alias("text"))
        return scan.scan(texts, query, limit, limits)

    def evidence(self, query: str) -> DataFrame:
        """Of a stale index: the first files in path order that share a term with the query, with some of their terms."""
        terms = F.array(*[F.lit(t) for t in scan.T.query_terms(query)]).cast("array<string>")
        hit = self.index.files.where(F.arrays_overlap("lexicalTerms", terms)).orderBy("path").limit(STALE_ROWS)
        return hit.select("path", F.array_join(F.slice("lexicalTerms", 1, STALE_TERMS), " ").alias("excerpt"))

    def payload(self, query: str, limit: int = 10) -> str:
        """The answer as JSON within the configured bytes."""
        rows = [r.asDict(recursive=True) for r in self.search(query, limit).collect()]
        evidence = [r.asDict() for r in self.evidence(query).collect()] if self.index is not None and self.freshness == "stale" else []
        diff = live.git_diff(self.root) if self.use_git and self.freshness == "stale" else ""
        return merge.bound_payload({"query": query, "freshness": self.freshness, "head": self.head, "results": rows, "evidence": evidence, "diff": diff, "pendingPaths": sorted({*self.pending, *self.maintenance.pending})}, self.config.searchMaxBytes)

    def excerpt(self, path: str) -> str | None:
        """The start of a file of a local tree as it is now, or None where it may not be shown."""
        try:
            return live.excerpt(self.root, path)
        except (live.Refused, OSError):
            return None

    def graph(self) -> graph.Graph:
        """The checked graph of what is served; raises ``graph.GraphError``."""
        guards.check_input(self.index.files)
        built = graph.build_graph(self.index.files)
        guards.check_graph(built)
        return built

    def status(self) -> DataFrame:
        """One row: lifecycle, freshness, generation, counts, the first pending and dirty paths, telemetry."""
        dirty = self.overlay if self.overlay is not None else self.spark.createDataFrame([], "path string, hash string")
        shown = [r["path"] for r in dirty.select("path").orderBy("path").limit(SHOWN_PATHS).collect()]
        files = self.index.files.count() if self.index is not None else 0
        pending = sorted({*self.pending, *self.maintenance.pending})
        row = (
            project_id(self.root), self.lifecycle, self.freshness, self.generation, self.head, files, state.revision(self.head, dirty).first()[0], pending[:SHOWN_PATHS], max(0, len(pending) - SHOWN_PATHS),
            shown, dirty.count() - len(shown), bool(self.failures) or self.lifecycle in ("warming", "failed"), dict(self.telemetry),
        )
        kinds = "project string, lifecycle string, freshness string, generation long, head string, files long, revision string, pending array<string>, omittedPending long, dirty array<string>, omittedDirty long, degraded boolean, telemetry map<string,long>"
        return self.spark.createDataFrame([row], kinds)

    def doctor(self) -> DataFrame:
        """``check, ok, detail``: whether what is stored can be read and is what is served."""
        checks = []

        def check(name: str, test) -> None:
            try:
                ok, detail = test()
            except Exception as e:
                ok, detail = False, f"{type(e).__name__}: {e}"[:200]
            checks.append((name, bool(ok), str(detail)))

        check("lifecycle", lambda: (self.lifecycle == "ready", self.lifecycle))
        check("pointer", lambda: ((self.store.active() or {}).get("generation") == self.generation, self.store.active()))
        check("generation", lambda: (set(self.store.load().columns) == set(self.spark.createDataFrame([], schema.FILES).columns), "columns"))
        check("quota", lambda: ((n := sum(self.store.generations().values())) <= self.config.quotaBytes, n))
        return self.spark.createDataFrame(checks, "check string, ok boolean, detail string")

    def close(self) -> None:
        self.index, self.content, self.lifecycle = None, None, "dormant"
