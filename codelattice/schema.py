"""Schemas, enumerations and errors of the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Class types and project states of the catalog, in their order.
CLASS_TYPES = ("CONTROLLER", "SERVICE", "REPOSITORY", "ENTITY", "DTO", "CONFIGURATION", "LISTENER", "UTILITY", "EXCEPTION", "OTHER")
PROJECT_STATUSES = ("PENDING", "ANALYZING", "ANALYZED", "ERROR", "SYNCING")
TRANSITIONS = {
    "PENDING": ("ANALYZING",),
    "ANALYZING": ("ANALYZED", "ERROR"),
    "ANALYZED": ("ANALYZING", "SYNCING"),
    "SYNCING": ("ANALYZED", "ERROR"),
    "ERROR": ("ANALYZING", "SYNCING"),
}

PROJECTS = "id string, name string, repository_url string, default_branch string, description string, status string, last_analyzed_at timestamp, created_at timestamp, updated_at timestamp, last_commit_hash string"
CLASSES = "id string, project_id string, full_class_name string, simple_name string, package_name string, class_type string, description string, source_file string, entry_point boolean, ordinal int, commit_hash string"
METHODS = "id string, class_id string, method_name string, description string, business_logic string, exceptions string, http_method string, http_path string, line_number int"
PARAMS = "method_id string, position int, class_id string"
EDGES = "project_id string, src string, dst string"
SOURCES = "project_id string, bundle string, src string"
TARGETS = "project_id string, bundle string, dst string"
FRAMES = "trace_id long, ord int, class_name string, method_name string, line_number int"
GRAPH_JSON = (
    "nodes map<string, struct<sourceFile:string, classId:string>>, edges map<string, array<string>>, entryPoints array<string>, "
    "methodParameters map<string, map<string, array<struct<position:int, target:string>>>>, nodeInfo map<string, struct<classType:string, description:string>>, "
    "methodInfo map<string, array<struct<methodName:string, description:string, businessLogic:array<string>, exceptions:array<string>, httpMethod:string, httpPath:string, lineNumber:int>>>"
)


class DomainError(Exception):
    """An error that callers tell apart by its code."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


def check_transition(current: str, target: str) -> str:
    """``target``, if a project may go there from ``current``."""
    if target not in TRANSITIONS.get(current, ()):
        raise DomainError(f"no way from {current} to {target}", "PROJECT_INVALID_TRANSITION")
    return target


@dataclass(frozen=True)
class Bundles:
    """Edges without a row for each: single ones, and all from each source of a bundle to each of its targets.

    ``single`` has an edge once and none that a bundle has, ``sources`` a name
    in one bundle only, ``targets`` a name once a bundle.
    """

    single: DataFrame
    sources: DataFrame
    targets: DataFrame


@dataclass(frozen=True)
class Catalog:
    """The tables of a code-knowledge catalog.

    ``classes`` are the nodes of each project's graph too: ``ordinal`` is their
    place in it. Logic and exceptions of methods are JSON lists, null if empty.
    ``bundles``, if there, say the same as ``edges``: whoever changes these sets
    them anew, or to None.
    """

    projects: DataFrame
    classes: DataFrame
    methods: DataFrame
    params: DataFrame
    edges: DataFrame
    frames: DataFrame | None = None
    bundles: Bundles | None = None

    def persist(self) -> Catalog:
        for table in (self.projects, self.classes, self.methods, self.params, self.edges):
            table.persist()
        return self
