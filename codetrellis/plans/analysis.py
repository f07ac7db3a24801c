"""The whole analysis: a table is computed when it is first asked for (K5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import scores
from codetrellis.functions.rulebook import Rulebook, ruled, using
from codetrellis.operators import components as comp
from codetrellis.operators import drift, explain, findings, graph, modules, ranking, routes, walks
from codetrellis.operators.declarations import declarations
from codetrellis.operators.facts import FactStore
from codetrellis.operators.references import references, resolve_references
from codetrellis.operators.resolve import call_edges, external_symbols, resolve_calls
from codetrellis.session import REPO_KEYS, cut


@dataclass(frozen=True)
class Options:
    """What an analysis includes and follows. Nothing is cut unless a limit is given; ``REPORT`` has those of a report."""

    include_external: bool = False
    tests_in_diagram: bool = False
    max_nodes: int | None = None
    max_edges: int | None = None
    include_tests: bool = True
    strip_import_comma: bool = False
    limits: findings.Limits = findings.Limits()
    #: rules beside the fixed ones, from rows
    rules: Rulebook | None = None
    #: facts of texts that earlier runs have read
    store: FactStore | None = None
    #: symbols at which the reach of a route's step ends
    reach_limit: int | None = None
    chain_depth: int | None = None
    column_depth: int = 5
    #: evidence for the kind of a project
    kind_files: int | None = None
    kind_hubs: int | None = None
    languages_shown: int | None = 3


#: fixed values: what a report shows
REPORT = {
    "max_nodes": modules.PICTURE_NODES, "max_edges": modules.PICTURE_EDGES, "limits": findings.REPORT,
    "reach_limit": 400, "chain_depth": 8, "kind_files": 400, "kind_hubs": 30,
}


class Report(Mapping):
    """Tables by name; each is built when it is taken out, so what nobody asks for never runs."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]], book: Rulebook | None = None):
        self._builders, self._book = builders, book

    def __getitem__(self, name: str) -> DataFrame:
        with using(self._book):
            return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Analysis:
    """Tables derived from ``files(repo, snap, path, language, content, lines)``.

    What several tables build on (declarations, resolved calls, symbols, the
    file graph) is written to the checkpoint folder once.
    """

    def __init__(self, files: DataFrame, options: Options = Options()):
        self.files = files
        self.options = options

    @cached_property
    @ruled
    def file_table(self) -> DataFrame:
        """The files without their text; counting files and lines never reads the text again."""
        return cut(self.files.drop("content"))

    @cached_property
    @ruled
    def _declared(self):
        return declarations(self.files, self.options.store)

    @cached_property
    @ruled
    def resolved(self) -> DataFrame:
        return cut(resolve_calls(self._declared.calls, self._declared.symbols))

    @cached_property
    @ruled
    def _externals(self) -> DataFrame | None:
        if not self.options.include_external:
            return None
        return cut(external_symbols(self.resolved, self._declared.symbols, self._declared.calls))

    @cached_property
    @ruled
    def edges(self) -> DataFrame:
        return cut(call_edges(self.resolved, self._externals))

    @cached_property
    @ruled
    def symbols(self) -> DataFrame:
        known = self._declared.symbols.withColumn("is_external", F.lit(False))
        if self._externals is not None:
            known = known.unionByName(self._externals, allowMissingColumns=True)
        shaped = known.withColumn("display", scores.display_name(F.col("container"), F.col("name"))).withColumn(
            "span", scores.span(F.col("line"), F.col("end_line"))
        )
        scored = shaped.withColumn(
            "score", scores.difficulty_score(F.col("branches"), F.col("max_nesting"), F.col("span"))
        )
        return cut(graph.with_degrees(scored, self.edges, REPO_KEYS, "sym_id"))

    @cached_property
    @ruled
    def file_refs(self) -> DataFrame:
        return cut(resolve_references(references(self.files, self.options.strip_import_comma), self.files))

    @cached_property
    @ruled
    def file_graph(self) -> modules.FileGraph:
        o = self.options
        built = modules.collapse(
            self.symbols, self.edges, self.file_refs, o.max_nodes, o.max_edges, o.tests_in_diagram
        )
        return modules.FileGraph(cut(built.modules), built.edges)

    @property
    def modules(self) -> DataFrame:
        return self.file_graph.modules

    @property
    def module_edges(self) -> DataFrame:
        return self.file_graph.edges

    @cached_property
    @ruled
    def components(self) -> DataFrame:
        ends = self.module_edges.withColumnsRenamed({"src_path": "src", "dst_path": "dst"})
        return comp.components(ends, REPO_KEYS).withColumnRenamed("node", "path")

    @cached_property
    @ruled
    def depths(self) -> DataFrame:
        ends = self.module_edges.withColumnsRenamed({"src_path": "src", "dst_path": "dst"})
        nodes = self.modules.select(*REPO_KEYS, F.col("path").alias("id"))
        return walks.depth(nodes, ends, REPO_KEYS, self.options.column_depth).withColumnRenamed("id", "path")

    @cached_property
    @ruled
    def findings(self) -> DataFrame:
        return findings.find_issues(
            self.symbols, self.modules, self.module_edges, self.components, self.options.limits
        )

    @cached_property
    @ruled
    def route(self) -> DataFrame:
        return cut(routes.route(self.symbols, self.edges))

    @ruled
    def route_with_reach(self) -> DataFrame:
        """Route steps with the number of symbols each step reaches."""
        inside = self.symbols.filter("is_external").select(*REPO_KEYS, F.col("sym_id").alias("dst"))
        edges = self.edges.join(inside, REPO_KEYS + ["dst"], "left_anti")
        asked = self.route.select(*REPO_KEYS, F.col("sym_id").alias("source"))
        found = walks.reach(edges, asked, REPO_KEYS, self.options.reach_limit).withColumnRenamed("source", "sym_id")
        return self.route.join(found, REPO_KEYS + ["sym_id"])

    @ruled
    def chains(self) -> DataFrame:
        nodes = self.symbols.select(*REPO_KEYS, F.col("sym_id").alias("id"))
        return walks.chains(nodes, self.edges, REPO_KEYS, self.options.chain_depth)

    @ruled
    def scan_record(self) -> DataFrame:
        return drift.scan_record(self.symbols)

    @ruled
    def cycle_record(self) -> DataFrame:
        return drift.cycle_record(self.components, self.modules)

    @ruled
    def explanations(self) -> DataFrame:
        return explain.explanations(self.symbols, self.edges)

    @ruled
    def summary(self) -> DataFrame:
        o = self.options
        return ranking.project_summary(
            self.file_table, self.symbols, self.edges, self.findings, max_files=o.kind_files, max_hubs=o.kind_hubs
        )

    @ruled
    def project_kinds(self) -> DataFrame:
        return ranking.project_kinds(self.file_table, self.symbols, self.options.kind_files, self.options.kind_hubs)

    def drift(self, history: DataFrame, cycles: DataFrame, scans: DataFrame, limit: int | None = None) -> DataFrame:
        """What moved since the scans before, with ``previous`` and its time.

        ``history`` and ``cycles`` hold the records of all scans, this one's included;
        ``scans`` is ``(repo, snap, scanned_at)``.
        """
        pairs = cut(drift.successions(scans))
        then = scans.select("repo", F.col("snap").alias("previous"), F.col("scanned_at").alias("previous_at"))
        return drift.compare(history, cycles, pairs, limit).join(pairs, REPO_KEYS).join(then, ["repo", "previous"])

    def tables(self, layout: bool = True) -> Report:
        """All tables of the report; ``layout`` adds the file graph's orders."""
        found: dict[str, Callable[[], DataFrame]] = {
            "files": lambda: self.file_table,
            "languages": lambda: ranking.top_languages(self.file_table, self.options.languages_shown),
            "symbols": lambda: self.symbols,
            "edges": lambda: self.edges,
            "file_refs": lambda: self.file_refs,
            "modules": lambda: self.modules,
            "module_edges": lambda: self.module_edges,
            "districts": lambda: modules.district_rollup(self.modules),
            "hubs": lambda: graph.hubs(self.symbols, REPO_KEYS, node="sym_id"),
            "chains": self.chains,
            "cycles": lambda: self.components,
            "findings": lambda: self.findings,
            "finding_counts": lambda: findings.finding_counts(self.findings),
            "project_kinds": self.project_kinds,
            "explanations": self.explanations,
            "route": self.route_with_reach,
            "scan_record": self.scan_record,
            "cycle_record": self.cycle_record,
            "summary": self.summary,
        }
        if layout:
            found["matrix"] = lambda: modules.matrix_order(self.modules)
            found["columns"] = lambda: modules.seed_order(self.modules, self.depths)
        return Report(found, self.options.rules)
