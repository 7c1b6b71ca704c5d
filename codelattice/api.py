"""The catalog service as a Python object, and as ``python -m codelattice.api FOLDER QUERY``."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.columns import is_repository_url, repository_name
from codelattice.operators import analyze, context, enrich, lookup, snapshots, sync
from codelattice.plans import dsl
from codelattice.schema import PROJECTS, Catalog, DomainError
from codelattice.sources import catalog as catalogs
from codelattice.storage import finished, scratch, stored
from codelattice.streaming import arrivals


#: Projects that are read by their own files, and how often a plan that fails is halved.
FEW, HALVINGS = 1000, 60


class Service:
    """Answers from the newest version of a catalog folder; every change is a new version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def catalog(self) -> Catalog:
        return catalogs.load(self.spark, self.folder)

    def query(self, text: str) -> DataFrame:
        """One row with resultType, project, count and results."""
        kind, rows = dsl.run(self.catalog, text)
        return dsl.envelope(kind, dsl.parse(text).project, rows)

    def query_pages(self, text: str, size: int = 100) -> DataFrame:
        """The same results as pages of ``size``, a row each: resultType, project, count, page and results."""
        kind, rows = dsl.run(self.catalog, text)
        return dsl.pages(kind, dsl.parse(text).project, rows, dsl.total_order(rows), size)

    def query_json(self, text: str) -> str:
        """The same as JSON; an error is ``{"error": code, "message": ...}``."""
        try:
            return self.query(text).toJSON().first()
        except DomainError as error:
            return json.dumps({"error": error.code, "message": str(error)})

    def _keys(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def class_context(self, *names: str) -> DataFrame:
        return context.class_context(self.catalog, self._keys([(n,) for n in names], "class_name string"))

    def method_context(self, *pairs: tuple[str, str]) -> DataFrame:
        return context.method_context(self.catalog, self._keys(list(pairs), "class_name string, method_name string"))

    def trace_context(self, frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Frames with context, the trace's project, and related dependencies."""
        traced = context.trace_context(self.catalog, frames)
        return traced, context.trace_projects(self.catalog, traced), context.related_dependencies(self.catalog, traced)

    def projects(self) -> DataFrame:
        return context.list_projects(self.catalog)

    def project(self, **key: str) -> DataFrame:
        """The project with this id, name or repository_url."""
        return lookup.project(self.catalog, **key)

    def search(self, *queries: tuple[str, str]) -> DataFrame:
        """A row for each (project, part of a class name)."""
        return context.search_results(self.catalog, self._keys(list(queries), "project string, query string"))

    def class_dependencies(self, *names: str) -> DataFrame:
        catalog = self.catalog
        wanted = lookup.classes_by_name(catalog, self._keys([(n,) for n in names], "class_name string")).select("project_id", F.col("full_class_name").alias("className"))
        return context.class_dependencies(catalog).join(wanted, ["project_id", "className"], "left_semi")

    def overview(self, *projects: str) -> DataFrame:
        return context.project_overview(self.catalog).filter(F.col("projectName").isin(*projects))

    def service_api(self, *projects: str) -> DataFrame:
        return context.service_api(self.catalog).filter(F.col("projectName").isin(*projects))

    def analyze(self, files: DataFrame, client: Callable[[list[str]], list[str]] | None = None, keep_descriptions: bool = False) -> None:
        """Reads the projects of ``files`` anew, with the client's descriptions if there is one.

        They are ANALYZING meanwhile, then ANALYZED, or ERROR if it fails.
        """
        ids = stored(files.select("project_id").distinct())
        self._publish(snapshots.set_statuses(self.catalog, ids, "ANALYZING"), "projects")
        try:
            with scratch(self.spark):
                catalog = self.catalog
                fresh = analyze.settled(analyze.analyze(catalog.projects, files))
                fresh = analyze.keeping_descriptions(catalog, fresh) if keep_descriptions else fresh
                self._publish(enrich.enriched(fresh, client, files) if client else fresh, *snapshots.OWNED, projects=ids)
        except Exception as failure:
            self._publish(snapshots.set_statuses(self.catalog, ids, "ERROR"), "projects")
            raise DomainError(str(failure), "REBUILD_FAILED" if keep_descriptions else "ANALYSIS_FAILED") from failure
        self._publish(snapshots.set_statuses(self.catalog, ids, "ANALYZED"), "projects")

    def rebuild(self, files: DataFrame) -> None:
        """The same without a client: what is said of classes and methods stays."""
        self.analyze(files, keep_descriptions=True)

    def _publish(self, catalog: Catalog, *changed: str, projects: DataFrame | None = None) -> None:
        snapshots.publish(catalog, self.folder, changed or snapshots.TABLES, projects)

    def _catalog_of(self, ids: DataFrame) -> Catalog:
        """The catalog of the projects ``ids`` (project_id), read from their files alone where they are few."""
        few = [r.project_id for r in ids.select("project_id").distinct().limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return catalogs.load(self.spark, self.folder, few)
        whole = self.catalog
        return snapshots.cascade(replace(whole, projects=whole.projects.join(ids.select(F.col("project_id").alias("id")).distinct(), "id", "left_semi").select(whole.projects.columns)))

    def register(self, url: str, branch: str = "main") -> DataFrame:
        """A version with one more project, PENDING; PROJECT_ALREADY_EXISTS for a URL that is there."""
        catalog = self.catalog
        if lookup.project_exists(catalog, url):
            raise DomainError(f"{url} is registered", "PROJECT_ALREADY_EXISTS")
        row = self._keys([(url,)], "repository_url string")
        if row.filter(is_repository_url(F.col("repository_url"))).isEmpty():
            raise ValueError(f"{url}: no repository URL")
        url_ = F.col("repository_url")
        new = row.select(F.sha2(url_, 256).alias("id"), repository_name(url_).alias("name"), url_, F.lit(branch).alias("default_branch"), F.lit("PENDING").alias("status"), F.current_timestamp().alias("created_at"))
        self._publish(replace(catalog, projects=snapshots.insert(catalog.projects, new)), "projects")
        return new

    def set_status(self, project_id: str, status: str) -> None:
        self._publish(snapshots.set_status(self.catalog, project_id, status), "projects")

    def delete(self, project_id: str) -> None:
        catalog = self.catalog
        gone = self._keys([(project_id,)], "project_id string")
        none = replace(catalog, **{name: getattr(catalog, name).limit(0) for name in snapshots.OWNED}, projects=snapshots.delete(catalog.projects, gone.select(F.col("project_id").alias("id")), "id"))
        self._publish(none, projects=gone)

    def synchronise(self, old_files: DataFrame, new_files: DataFrame, client: Callable[[list[str]], list[str]] | None = None, full: DataFrame | None = None) -> DataFrame:
        """Publishes the catalog for the new files and returns what became of each class.

        Of the projects ``full`` (project_id) every class is read and asked about
        again, changed or not. A client is asked about classes without a
        description. Where no file changed, no version is written, and only the
        projects in which one did are.
        """
        return finished(self.spark, lambda: self._synchronised(self.catalog, old_files, new_files, client, full))

    def _synchronised(self, catalog: Catalog, old_files: DataFrame, new_files: DataFrame, client, full: DataFrame | None) -> DataFrame:
        fresh, actions = analyze.synchronise(catalog, old_files, new_files, full)
        changed = stored(actions.filter("action != 'keep'").select("project_id").distinct())
        if not changed.isEmpty():
            self._publish(enrich.enriched(fresh, client, new_files) if client else fresh, *snapshots.OWNED, projects=changed)
        return actions

    def follow(self, folder: str, client: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
        """Synchronises with what arrived in ``folder`` (``streaming.arrivals``) since the last time, and returns what became of each class.

        Only what arrived is read and compared; of the projects in which a file
        changed, the files are put together from the changes so far.
        """

        def made() -> DataFrame:
            found, _ = arrivals.read_arrivals(self.spark, folder)
            touched = stored(found.filter("change != 'same'").select("project_id").distinct())
            if touched.isEmpty():
                return self._keys([], "project_id string, full_class_name string, action string")
            first = found.agg(F.min("batch")).first()[0]
            mine = arrivals.all_changes(self.spark, folder).join(touched, "project_id", "left_semi")
            old, new = stored(arrivals.files_after(mine.filter(F.col("batch") < first))), stored(arrivals.files_after(mine))
            return self._synchronised(self._catalog_of(touched), old, new, client, None)

        return finished(self.spark, made)

    def synchronise_all(self, old_files: DataFrame, new_files: DataFrame, client: Callable[[list[str]], list[str]] | None = None, full: DataFrame | None = None) -> DataFrame:
        """Synchronises every project that is ANALYZED or ERROR, and returns ``sync.outcomes`` of each.

        They are SYNCING meanwhile, then ANALYZED or, each for itself, ERROR.
        Projects that could not be read (``sync.project_errors``) stay as they
        were. All others are one plan; where that fails, its halves are tried,
        until what fails is one project, so the others are published.
        """

        def made() -> DataFrame:
            catalog = self.catalog
            eligible = stored(lookup.projects_in(catalog, "ANALYZED", "ERROR"))
            ids = eligible.select(F.col("id").alias("project_id"))
            if eligible.isEmpty():
                return sync.outcomes(eligible, self._keys([], "project_id string, action string"), self._keys([], "project_id string, error string"))
            self._publish(snapshots.set_statuses(catalog, ids, "SYNCING"), "projects")
            lost = stored(sync.project_errors(new_files).join(ids, "project_id", "left_semi"))
            done, failed = self._in_halves(stored(ids.join(lost, "project_id", "left_anti")), old_files, new_files, client, full)
            errors = stored(reduce(DataFrame.union, failed, lost))
            actions = reduce(DataFrame.union, done, self._keys([], "project_id string, full_class_name string, action string"))
            out = stored(sync.outcomes(eligible, actions, errors))
            for status in ("ERROR", "ANALYZED"):
                of = out.filter(F.col("status") == status)
                if not of.isEmpty():
                    self._publish(snapshots.set_statuses(self.catalog, of, status), "projects")
            return out

        return finished(self.spark, made)

    def _in_halves(self, ids: DataFrame, old_files: DataFrame, new_files: DataFrame, client, full: DataFrame | None, level: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
        """What became of the classes of the projects ``ids``, and the error of each project whose plan fails alone."""
        if ids.isEmpty():
            return [], []
        mine = lambda frame: frame.join(ids, "project_id", "left_semi")
        try:
            return [stored(self._synchronised(self._catalog_of(ids), mine(old_files), mine(new_files), client, None if full is None else mine(full)))], []
        except Exception as failure:
            if level == HALVINGS or ids.count() == 1:
                return [], [ids.select("project_id", F.lit(str(failure).split("\n")[0][:500]).alias("error"))]
        halves = [stored(ids.filter(F.getbit(F.xxhash64("project_id"), F.lit(level)) == bit)) for bit in (0, 1)]
        done, failed = zip(*(self._in_halves(half, old_files, new_files, client, full, level + 1) for half in halves), strict=True)
        return sum(done, []), sum(failed, [])


def create(spark: SparkSession, folder: str, projects: DataFrame | None = None, files: DataFrame | None = None) -> Service:
    """A service over a new folder, with the projects and files given."""
    projects = projects if projects is not None else spark.createDataFrame([], PROJECTS)
    files = files if files is not None else spark.createDataFrame([], "project_id string, path string, length long, content string")
    with scratch(spark):
        snapshots.publish(analyze.analyze(projects, files), folder)
    return Service(spark, folder)


if __name__ == "__main__":
    print(Service(SparkSession.builder.getOrCreate(), sys.argv[1]).query_json(sys.argv[2]))
