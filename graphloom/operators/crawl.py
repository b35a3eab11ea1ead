"""Routes, database models and service calls from lines and blocks of source text, by patterns.

``lines`` are (path, line_no, line) of files whose comments are blanked, ``files`` (path, content).
Look-ahead and carry-forward are windows over the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.operators.lines import carry_forward, islands, look_ahead

ROUTE = ("method", "path", "handler_name", "file_path", "line_start", "line_end", "framework", "params")


def _extract(column: str, pattern: str, group: int) -> Column:
    return F.regexp_extract(column, pattern, group)


def _routes(rows: DataFrame, method: Column, path: Column, handler: Column, end: Column, framework: str, params: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.select(method.alias("method"), path.alias("path"), handler.alias("handler_name"), F.col("file_path"), F.col("line_no").alias("line_start"), end.alias("line_end"), F.lit(framework).alias("framework"), (none if params is None else params).alias("params"))


def python_routes(lines: DataFrame, most: int = 14) -> DataFrame:
    """Decorated handlers (the first ``def`` in the next ``most`` lines) and Django paths."""
    rows = lines.withColumnRenamed("path", "file_path")
    d = F.when(F.col("line").rlike(fixed.PY_DEF), F.struct(F.col("line_no").alias("at"), _extract("line", fixed.PY_DEF, 1).alias("name"), _extract("line", fixed.PY_DEF, 2).alias("args")))
    ahead = look_ahead(rows, d, ["file_path"], ["line_no"], most, "handler").where(F.col("line").rlike(fixed.PY_ROUTE))
    verb, named = F.upper(_extract("line", fixed.PY_ROUTE, 1)), _extract("line", fixed.PY_ROUTE_METHODS, 1)
    method = F.when(verb == "ROUTE", F.when(named != "", F.upper(named)).otherwise("GET")).otherwise(verb)
    args = F.filter(F.transform(F.split(F.col("handler.args"), ","), lambda x: F.trim(x)), lambda a: (a != "") & (a != "self"))
    params = F.coalesce(F.transform(args, lambda a: F.trim(F.substring_index(a, ":", 1))), F.array().cast("array<string>"))
    decorated = _routes(ahead, method, _extract("line", fixed.PY_ROUTE, 2), F.coalesce("handler.name", F.lit("unknown_handler")), F.coalesce("handler.at", "line_no"), "FastAPI/Flask", params)
    django = rows.where(F.col("line").rlike(fixed.DJANGO_ROUTE))
    django = _routes(django, F.lit("ANY"), F.concat(F.lit("/"), F.regexp_replace(_extract("line", fixed.DJANGO_ROUTE, 1), r"^/+", "")), F.substring_index(_extract("line", fixed.DJANGO_ROUTE, 2), ".", -1), F.col("line_no"), "Django")
    return decorated.unionByName(django)


def script_routes(lines: DataFrame) -> DataFrame:
    """Express calls, and exported verbs of files that the directory routes."""
    rows = lines.withColumnRenamed("path", "file_path")
    express = rows.where(F.col("line").rlike(fixed.EXPRESS_ROUTE))
    handler = F.regexp_extract(_extract("line", fixed.EXPRESS_ROUTE, 3), fixed.EXPRESS_HANDLER, 1)
    express = _routes(express, F.upper(_extract("line", fixed.EXPRESS_ROUTE, 1)), _extract("line", fixed.EXPRESS_ROUTE, 2), F.when(handler != "", handler).otherwise("anonymous_handler"), F.col("line_no"), "Express")
    by_folder = rows.where(F.contains("file_path", F.lit("app/")) & (F.contains("file_path", F.lit("route.ts")) | F.contains("file_path", F.lit("route.js"))) & F.col("line").rlike(fixed.NEXT_ROUTE))
    # what follows "/app/"; without it the path begins with app/, and five characters from the second go
    sub = F.replace(F.replace(F.expr("substring(file_path, instr(file_path, '/app/') + 5)"), F.lit("/route.ts"), F.lit("")), F.lit("/route.js"), F.lit(""))
    verb = F.upper(_extract("line", fixed.NEXT_ROUTE, 1))
    by_folder = _routes(by_folder, verb, F.concat(F.lit("/"), sub), F.concat(verb, F.lit("_"), F.replace(sub, F.lit("/"), F.lit("_"))), F.col("line_no"), "Next.js App Route")
    return express.unionByName(by_folder)


def go_routes(lines: DataFrame) -> DataFrame:
    rows = lines.withColumnRenamed("path", "file_path").where(F.col("line").rlike(fixed.GO_ROUTE))
    verb = _extract("line", fixed.GO_ROUTE, 1)
    return _routes(rows, F.when(verb == "HandleFunc", "ANY").otherwise(F.upper(verb)), _extract("line", fixed.GO_ROUTE, 2), _extract("line", fixed.GO_ROUTE, 3), F.col("line_no"), "Go/Gin/Chi")


def routes(lines: DataFrame) -> DataFrame:
    """Routes of all languages; ``lines`` has language too."""
    of = lambda *names: lines.where(F.col("language").isin(*names)).select("path", "line_no", "line")
    found = python_routes(of("python")).unionByName(script_routes(of("typescript", "javascript"))).unionByName(go_routes(of("go")))
    arrow = F.when(F.col("framework") == "FastAPI/Flask", " handled by ").otherwise(" -> ")
    plain = F.concat_ws(" ", "method", "path")
    return found.withColumn("summary", F.when(F.col("framework") == "Next.js App Route", plain).otherwise(F.concat(plain, arrow, F.col("handler_name"))))


MODEL = ("name", "table_name", "file_path", "line_start", "line_end", "orm_type", "fields", "relationships")
_FIELD = "array<struct<name:string,field_type:string,is_primary_key:boolean,is_foreign_key:boolean,references:string>>"


def _blocks(files: DataFrame, pattern: str) -> DataFrame:
    """name, body and first line of every match of a two-group pattern in whole texts, by position."""
    whole = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(whole.alias("whole"), F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("body"), F.slice(F.split("content", pattern, -1), 1, F.size(whole)).alias("gap"))
    rows = files.select(F.col("path").alias("file_path"), F.posexplode(zipped).alias("k", "m")).select("file_path", "k", "m.*")
    newlines = lambda c: F.regexp_count(c, F.lit("\n"))
    w = Window.partitionBy("file_path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(newlines(F.col("gap")) + newlines(F.col("whole"))).over(w), F.lit(0))
    return rows.withColumn("line_start", (before + newlines(F.col("gap")) + 1).cast("int")).withColumn("line_end", (F.col("line_start") + newlines(F.col("body"))).cast("int"))


def _field_lines(body: str, skip: tuple[str, ...]) -> Column:
    trimmed = F.filter(F.transform(F.split(body, "\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    for s in skip:
        trimmed = F.filter(trimmed, _not_starting(s))
    return F.filter(trimmed, lambda x: F.size(F.split(x, r"\s+")) >= 2)


def _not_starting(s: str):
    return lambda x: ~x.startswith(s)


def prisma_models(files: DataFrame) -> DataFrame:
    rows = _blocks(files, fixed.PRISMA_MODEL)

    def field(x: Column) -> Column:
        words, ref = F.split(x, r"\s+"), F.regexp_extract(x, fixed.PRISMA_REFERENCES, 1)
        foreign = F.contains(x, F.lit("@relation"))
        return F.struct(F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).alias("field_type"), F.contains(x, F.lit("@id")).alias("is_primary_key"), foreign.alias("is_foreign_key"), F.when(foreign & (ref != ""), F.trim(ref)).alias("references"))

    out = rows.withColumn("fields", F.transform(_field_lines("body", ("//", "@@")), field))
    links = F.transform(F.filter("fields", lambda f: f["references"].isNotNull()), lambda f: F.concat(F.col("name"), F.lit(" -> "), f["field_type"], F.lit("("), f["references"], F.lit(")")))
    return out.select("name", F.concat(F.lower("name"), F.lit("s")).alias("table_name"), "file_path", "line_start", "line_end", F.lit("Prisma").alias("orm_type"), F.col("fields").cast(_FIELD).alias("fields"), links.alias("relationships"))


def go_models(files: DataFrame) -> DataFrame:
    rows = _blocks(files, fixed.GO_MODEL).where(F.contains("body", F.lit("gorm:")) | F.contains("body", F.lit("db:")) | F.contains("body", F.lit("sql:")))

    def field(x: Column) -> Column:
        words = F.split(x, r"\s+")
        first = F.get(words, F.lit(0))
        return F.struct(first.alias("name"), F.get(words, F.lit(1)).alias("field_type"), (F.contains(x, F.lit("primaryKey")) | (first == "ID")).alias("is_primary_key"), F.lit(False).alias("is_foreign_key"), F.lit(None).cast("string").alias("references"))

    fields = F.transform(_field_lines("body", ("//",)), field).cast(_FIELD)
    return rows.select("name", F.concat(F.lower("name"), F.lit("s")).alias("table_name"), "file_path", "line_start", "line_end", F.lit("GORM").alias("orm_type"), fields.alias("fields"), F.array().cast("array<string>").alias("relationships"))


def python_models(lines: DataFrame) -> DataFrame:
    """Classes of the known bases with the indented or empty lines that follow: runs between dedents."""
    rows = lines.withColumnRenamed("path", "file_path")
    head = F.regexp_extract("line", fixed.PY_MODEL, 1)
    body = F.col("line").rlike(r"^(    |\t)") | (F.trim("line") == "")
    runs = islands(rows.withColumn("head", head), (F.col("head") != "") | ~body, ["file_path"], ["line_no"], "run")
    first = carry_forward(runs, F.when(F.col("head") != "", F.col("head")), ["file_path", "run"], ["line_no"], "name").where("name is not null")
    t = F.trim("line")
    table = F.when(t.startswith("__tablename__"), F.nullif(F.regexp_extract(t, fixed.PY_TABLE, 1), F.lit("")))
    args = F.regexp_extract(t, fixed.PY_FIELD, 2)
    foreign, ref = F.contains(args, F.lit("ForeignKey")), F.regexp_extract(args, fixed.PY_FOREIGN, 1)
    field = F.when((F.col("head") == "") & t.rlike(fixed.PY_FIELD), F.struct("line_no", F.regexp_extract(t, fixed.PY_FIELD, 1).alias("name"), F.when(args != "", F.trim(F.substring_index(args, ",", 1))).otherwise("Unknown").alias("field_type"), F.contains(args, F.lit("primary_key=True")).alias("is_primary_key"), foreign.alias("is_foreign_key"), F.when(foreign & (ref != ""), ref).alias("references")))
    per = first.groupBy("file_path", "run").agg(F.first("name").alias("name"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.max_by(table, F.when(table.isNotNull(), F.col("line_no"))).alias("table"), F.array_sort(F.collect_list(field)).alias("fields"))
    links = F.transform(F.filter("fields", lambda f: f["references"].isNotNull()), lambda f: F.concat(F.col("name"), F.lit("."), f["name"], F.lit(" -> "), f["references"]))
    return per.select("name", F.coalesce("table", F.concat(F.lower("name"), F.lit("s"))).alias("table_name"), "file_path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.lit("SQLAlchemy/Django").alias("orm_type"), F.transform("fields", lambda f: f.dropFields("line_no")).cast(_FIELD).alias("fields"), links.alias("relationships"))


def script_models(lines: DataFrame) -> DataFrame:
    """Entities: the first class in the four lines after the mark."""
    rows = lines.withColumnRenamed("path", "file_path")
    c = F.when(F.col("line").rlike(fixed.TS_ENTITY_CLASS), F.struct(F.col("line_no").alias("at"), _extract("line", fixed.TS_ENTITY_CLASS, 1).alias("name")))
    found = look_ahead(rows, c, ["file_path"], ["line_no"], 4, "c").where(F.contains("line", F.lit("@Entity")) & F.col("c").isNotNull())
    none = F.array()
    return found.select(F.col("c.name").alias("name"), F.concat(F.lower("c.name"), F.lit("s")).alias("table_name"), "file_path", F.col("line_no").cast("int").alias("line_start"), (F.col("c.at") + 9).cast("int").alias("line_end"), F.lit("TypeORM").alias("orm_type"), none.cast(_FIELD).alias("fields"), none.cast("array<string>").alias("relationships"))


def models(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Models of all kinds; both inputs have language (prisma too)."""
    whole = lambda n: files.where(F.col("language") == n).select("path", "content")
    of = lambda *n: lines.where(F.col("language").isin(*n)).select("path", "line_no", "line")
    return prisma_models(whole("prisma")).unionByName(python_models(of("python"))).unionByName(script_models(of("typescript", "javascript"))).unionByName(go_models(whole("go")))


def service_calls(lines: DataFrame) -> DataFrame:
    """Client calls with the last exported name above them (the file's stem before the first)."""
    rows = lines.withColumnRenamed("path", "file_path")
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"(?<=.)\.[^.]*$", "")
    export = F.nullif(_extract("line", fixed.NAMED_EXPORT, 1), F.lit(""))
    js = carry_forward(rows.where(F.col("language").isin("typescript", "javascript")), export, ["file_path"], ["line_no"], "current")

    def every(rows: DataFrame, pattern: str, verb: int, endpoint: int, library: str, name: Column) -> DataFrame:
        zipped = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(verb)).alias("verb"), F.regexp_extract_all("line", F.lit(pattern), F.lit(endpoint)).alias("endpoint"))
        hits = rows.where(F.col("line").rlike(pattern)).select("file_path", "line_no", name.alias("function_name"), stem.alias("calling_component"), F.posexplode(zipped).alias("k", "m"))
        method = F.upper(F.coalesce(F.nullif(F.col("m.verb"), F.lit("")), F.lit("GET")))
        return hits.select("function_name", F.col("m.endpoint").alias("target_endpoint"), method.alias("http_method"), "file_path", F.col("line_no").alias("line_number"), F.lit(library).alias("client_library"), "calling_component", "k")

    own = F.coalesce("current", stem)
    py = rows.where("language = 'python'")
    out = every(js, fixed.AXIOS_CALL, 1, 2, "Axios", own).unionByName(every(js, fixed.FETCH_CALL, 2, 1, "Fetch", own)).unionByName(every(py, fixed.PY_HTTP_CALL, 1, 2, "Requests/HTTPX", stem))
    return out.drop("k")


def layer(rows: DataFrame, order: list[str], most: int = fixed.LAYER) -> DataFrame:
    """The first rows of a layer by file and line."""
    return rows.orderBy(*order).limit(most)


def layer_status(rows: DataFrame, name: str) -> DataFrame:
    """layer, status, n: how the layer was found and how much of it."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), F.lit("regex-heuristic").alias("status"), "n")
