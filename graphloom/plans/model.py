"""The repository model: files to symbols, edges and every relation derived from them, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed, text
from graphloom.operators import crawl, delta, extract, graph, insights, lines, payloads, report, resolve, ripple
from graphloom.sources import files as sources
from graphloom.sources.shared import ensure_checkpoint_dir


def symbols_of(files: DataFrame, records: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Enriched symbols of files (path, content): one row an id, the first in order of file and position.

    Bodies come with the records; complexity from the parser for Python and from tokens for
    other languages. All symbols are kept unless the caller asks for ``cap``, as a small display may
    (``fixed.SYMBOLS``): then tests go first, then symbols with the fewest calls.
    """
    rows = extract.extract(extract.wanted_files(files)) if records is None else records
    s = rows.where(F.col("record").isin("symbol", "method")).withColumn("late", F.col("record") == "method")
    kind = F.when(F.col("type") == "struct", "class").otherwise(F.col("type"))
    qualified = text.qualified("id", "name")
    # all that a body is needed for, so that bodies are not shuffled
    s = s.withColumn("plain", text.strip_comments("body", "language")).select(
        "id", "name", qualified.alias("qualified"), kind.alias("kind"), "file_path", text.module_key("file_path").alias("module"), "line_start", "line_end", "language",
        text.parent_of(qualified).alias("parent"), "exported", F.col("name").startswith("_").alias("private"), text.is_test_path("file_path").alias("is_test"),
        F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("complexity", text.lexical_complexity("plain")).alias("complexity"), text.capability_flags("plain").alias("flags"),
        "parameters", F.coalesce("return_type", F.lit("")).alias("returns"), F.slice("calls", 1, fixed.RAW_CALLS).alias("raw_calls"), F.slice("imports", 1, fixed.IMPORTS).alias("imports"),
        text.sha20("body").alias("hash"), F.when(F.col("late"), "regex").otherwise("ast").alias("source"), "ord", "late",
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy("late", "ord"))
    s = s.withColumn("k", first).where("k = 1").drop("k", "late")
    if cap is None:
        return s
    return s.orderBy("is_test", F.desc(F.size("raw_calls")), "id").limit(cap)


def edges_of(symbols: DataFrame) -> DataFrame:
    """Resolved calls (src, dst, pos)."""
    calls = symbols.select(F.col("id").alias("src"), F.posexplode("raw_calls").alias("pos", "raw"))
    return resolve.resolve_calls(symbols, calls)


@dataclass
class Model:
    """All relations of one source tree; each is planned when first asked for."""

    files: DataFrame
    languages: list[str] | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None
    history: DataFrame | None = None
    cap: int | None = None
    _: None = field(default=None, repr=False)

    @cached_property
    def records(self) -> DataFrame:
        return extract.extract(extract.wanted_files(self.files, self.languages, self.include, self.exclude)).persist()

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols_of(self.files, self.records, self.cap).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return edges_of(self.symbols).persist()

    @cached_property
    def raw_edges(self) -> DataFrame:
        e = self.records.where("record = 'edge'")
        first = F.row_number().over(Window.partitionBy("src", "dst", "edge").orderBy("file_path", "ord"))
        return e.withColumn("k", first).where("k = 1").select("src", "dst", F.col("edge").alias("type"))

    @cached_property
    def entries(self) -> DataFrame:
        e = self.records.where("record = 'entry'").select(F.col("id").alias("symbol_id"), "type", F.col("entry").alias("kind"), "file_path", F.col("line_start").alias("line"))
        return resolve.entry_points(e.withColumn("ord", F.struct("file_path", "line", "symbol_id")), self.symbols)

    @cached_property
    def enriched(self) -> DataFrame:
        """Symbols with callees in order of first call, sorted callers, children and hash of both lists."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("calls"))
        none = F.array().cast("array<string>")
        s = self.symbols.join(out, "id", "left").join(graph.callers(self.edges), "id", "left").join(resolve.children(self.symbols), "id", "left")
        s = s.withColumns({c: F.coalesce(c, none) for c in ("calls", "callers", "children")})
        return s.withColumn("deps_hash", text.deps_hash("calls", "callers"))

    @cached_property
    def file_meta(self) -> DataFrame:
        return sources.file_meta(self.files, self.symbols, self.history)

    @cached_property
    def components(self) -> DataFrame:
        return graph.components(graph.function_edges(self.symbols, self.edges))

    @cached_property
    def classes(self) -> DataFrame:
        return graph.cluster_classes(self.symbols, self.edges, self.components)

    @cached_property
    def pivotal(self) -> DataFrame:
        return graph.pivotal(self.symbols, self.edges)

    @cached_property
    def flows(self) -> DataFrame:
        known = self.entries.where("resolved").select("ord", F.col("symbol_id").alias("id"))
        entries = known if known.limit(1).count() else graph.hubs(self.symbols, self.edges)
        return graph.flows(entries, self.symbols, self.edges)

    @cached_property
    def module_edges(self) -> DataFrame:
        imports = self.symbols.select("id", "file_path", "language", F.explode("imports").alias("import"))
        found = resolve.resolve_imports(imports, self.files)
        crossing = imports.join(found, ["language", "import"]).where("file_path <> path").select(text.module_key("file_path").alias("src_module"), text.module_key("path").alias("dst_module")).where("src_module <> dst_module")
        by_import = crossing.groupBy("src_module", "dst_module").agg(F.count("*").alias("weight")).withColumn("type", F.lit("imports"))
        return graph.top_module_edges(graph.module_edges(self.symbols, self.edges).unionByName(by_import))

    @cached_property
    def modules(self) -> DataFrame:
        return graph.module_nodes(self.symbols, self.components)

    @cached_property
    def code_lines(self) -> DataFrame:
        """Lines of production files, comments blanked, with language."""
        own = sources.source_files(self.files, (*fixed.LANGUAGES, ".prisma"))
        lang = F.when(F.col("path").endswith(".prisma"), "prisma").otherwise(text.language("path"))
        blank = own.withColumn("language", lang).withColumn("content", extract.blank_comments("content", "language"))
        return lines.explode_lines(blank).join(blank.select("path", "language"), "path")

    @cached_property
    def routes(self) -> DataFrame:
        return crawl.layer(crawl.routes(self.code_lines), ["file_path", "line_start", "method"])

    @cached_property
    def models(self) -> DataFrame:
        own = sources.source_files(self.files, (".prisma", ".go")).withColumn("language", F.when(F.col("path").endswith(".prisma"), "prisma").otherwise("go"))
        return crawl.layer(crawl.models(own, self.code_lines), ["file_path", "line_start", "name"])

    @cached_property
    def services(self) -> DataFrame:
        return crawl.layer(crawl.service_calls(self.code_lines), ["file_path", "line_number", "target_endpoint"])

    # queries

    def stats(self) -> DataFrame:
        calls = self.symbols.select(F.explode("raw_calls"))
        return report.repo_stats(self.file_meta, self.symbols, self.edges, calls)

    def find(self, needle: str) -> DataFrame:
        return resolve.find_symbol(self.symbols, self.files.sparkSession.createDataFrame([(needle,)], "needle string"))

    def context(self, needle: str, most: int = 120) -> DataFrame:
        """The symbol with callers, callees, the first flows that it is on, and its source."""
        hit = self.find(needle).where("status = 'found'").select("id")
        s = self.enriched.join(hit, "id", "left_semi").join(self.files.select(F.col("path").alias("file_path"), "content"), "file_path")
        s = s.withColumn("source_text", lines.source_slice("content", "line_start", "line_end", 0, most)).drop("content")
        on = graph.flow_membership(self.flows, hit)
        return s.join(on, "id", "left").withColumn("flows", F.coalesce("flows", F.array().cast(on.schema["flows"].dataType)))

    def entry_flows(self) -> DataFrame:
        """Entry points with the flow that starts at them."""
        return graph.entry_flows(self.entries, self.flows, self.symbols)

    def usages(self, needle: str) -> DataFrame:
        calls = self.symbols.select(F.col("id").alias("src"), F.posexplode("raw_calls").alias("pos", "raw"))
        return resolve.usages(self.symbols, self.edges, calls, self.find(needle).where("status = 'found'").select("id"))

    def dependencies(self) -> DataFrame:
        return graph.blast_radius(self.file_meta.select("path", "is_production"), self.symbols, self.edges)

    def ripple(self, needle: str) -> DataFrame:
        hit = self.find(needle).where("status = 'found'").select("id")
        calls = self.symbols.select(F.col("id").alias("src"), F.posexplode("raw_calls").alias("pos", "raw"))
        return ripple.downstream(self.symbols.join(hit, "id", "left_semi"), self.symbols, self.edges, self.entries, calls)

    def manifest(self) -> DataFrame:
        return delta.manifest(self.enriched)

    def insights(self) -> DataFrame:
        return insights.automatic(self.enriched)

    def tree(self) -> DataFrame:
        return graph.tree_rows(self.symbols)

    def refresh(self, files: DataFrame | None = None) -> None:
        """Go on with ``files``: only what changed is extracted and resolved again, if symbols and edges were known.

        Files are compared by path and content. Records, symbols and edges of other files stay, but for
        calls that the edit may have given another meaning; the rest is planned anew when asked for.
        Without files, or with a cap on symbols, everything is.
        """
        known = {n: self.__dict__[n] for n in ("records", "symbols", "edges") if n in self.__dict__}
        fresh: dict[str, DataFrame] = {}
        if files is not None and len(known) == 3 and self.cap is None:
            ensure_checkpoint_dir(files.sparkSession)
            both = self.files.select("path", F.col("content").alias("was"), F.lit(True).alias("old")).join(files.select("path", F.col("content").alias("now"), F.lit(True).alias("new")), "path", "full_outer")
            paths = both.where(F.col("old").isNull() | F.col("new").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).select("path").checkpoint()
            gone = paths.select(F.col("path").alias("file_path"))
            changed = files.join(paths, "path", "left_semi")
            records = extract.extract(extract.wanted_files(changed, self.languages, self.include, self.exclude)).checkpoint()
            symbols = known["symbols"].join(gone, "file_path", "left_anti").unionByName(symbols_of(changed, records)).checkpoint()
            calls = symbols.select(F.col("id").alias("src"), F.posexplode("raw_calls").alias("pos", "raw"))
            edges = resolve.resolved_again(known["symbols"], symbols, known["edges"], calls, paths).checkpoint()
            fresh = {"records": known["records"].join(gone, "file_path", "left_anti").unionByName(records).checkpoint(), "symbols": symbols, "edges": edges}
        for df in known.values():
            df.unpersist()
        for name in [n for n in self.__dict__ if isinstance(getattr(type(self), n, None), cached_property)]:
            del self.__dict__[name]
        if files is not None:
            self.files = files
        self.__dict__.update(fresh)

    def payload(self, route: str, needle: str = "", detail: int = 2) -> DataFrame:
        """What a route of the service answers, as one relation; the routes are those of ``ROUTES``."""
        if route not in ROUTES:
            raise ValueError(f"no such route: {route}")
        return ROUTES[route](self, needle, detail)

    def write_json(self, at: str) -> None:
        """Symbols with all that is known of them, edges, entry points, flows, modules and files, each as JSON lines in a folder below ``at``."""
        for name, df in (("symbols", self.enriched), ("edges", self.edges), ("entry_points", self.entries), ("flows", self.flows), ("modules", self.modules), ("module_edges", self.module_edges), ("files", self.file_meta)):
            df.write.mode("overwrite").json(f"{at}/{name}")

    def dossier(self, detail: int = 2, title: str = "Repository") -> str:
        """The report as one document; levels hold more the higher they are."""
        caps = report.level(detail)
        sections = [("Statistics", self.stats()), ("Key routines", report.key_routines(self.pivotal, self.symbols, caps["routines"])), ("Modules", self.modules.orderBy(F.desc("symbols"), "module").limit(caps["modules"])), ("Risks", report.risk_register(self.symbols, self.components).limit(caps["risks"])), ("Reading order", report.reading_order(self.entries, report.key_routines(self.pivotal, self.symbols, 5), self.models, self.components))]
        if caps["files"]:
            sections.append(("Source inventory", report.file_inventory(self.file_meta, caps["files"])))
            sections.append(("Routes", self.routes.select("method", "path", "handler_name", "file_path", "line_start")))
        if caps["deep"]:
            sections.append(("Symbol evidence", report.deep_candidates(self.pivotal, self.symbols, self.classes.where("class in ('cyclic', 'dynamic')"), caps["deep"])))
        return report.html(sections, title)


def _health(m: Model, needle: str, detail: int) -> DataFrame:
    stats = m.stats()
    return stats.select(F.lit("ok").alias("status"), "files", "symbols")


def _documented(m: Model, needle: str, detail: int) -> DataFrame:
    hit = m.find(needle).where("status = 'found'").select("id")
    return ripple.documentation(m.symbols.join(hit, "id", "left_semi"))


def _context(m: Model, needle: str, detail: int) -> DataFrame:
    hit = m.context(needle)
    on = m.flows.select("ord", F.posexplode("path").alias("pos", "id")).join(m.symbols.select("id", "name"), "id")
    chain = on.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("chain"))
    own = hit.select("id", F.posexplode("flows").alias("k", "flow")).select("id", "k", "flow.ord").join(chain, "ord")
    flows = own.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chain"))), lambda x: F.struct(F.get(x["chain"], F.lit(0)).alias("entry"), x["chain"].alias("chain"))).alias("flows"))
    return payloads.context(hit, m.symbols, m.insights(), flows)


def _usages(m: Model, needle: str, detail: int) -> DataFrame:
    hit = m.find(needle).where("status = 'found'").select("id")
    return payloads.usages(m.symbols.join(hit, "id", "left_semi"), m.symbols, m.edges)


def _tree(m: Model, needle: str, detail: int) -> DataFrame:
    return payloads.tree_view(m.file_meta, m.symbols, m.pivotal, max(1, min(3, detail)))


def _dossier(m: Model, needle: str, detail: int) -> DataFrame:
    """level, cards and the report as one document: its sections are capped tables, whatever the tree's size."""
    level = max(1, min(3, detail))
    cards = report.metric_cards(m.stats(), level).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "n"))), lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias("cards"))
    return cards.select(F.lit(level).alias("level"), "cards", F.lit(m.dossier(level)).alias("html"))


#: Routes by name: functions of the model, a symbol's name and the level of detail.
ROUTES = {
    "health": _health,
    "stats": lambda m, needle, detail: m.stats(),
    "model": lambda m, needle, detail: m.enriched,
    "tree": _tree,
    "context": _context,
    "usages": _usages,
    "dependencies": lambda m, needle, detail: m.dependencies(),
    "ripple": lambda m, needle, detail: m.ripple(needle),
    "doc": _documented,
    "delta": lambda m, needle, detail: m.manifest(),
    "index": lambda m, needle, detail: m.insights(),
    "dossier": _dossier,
}
