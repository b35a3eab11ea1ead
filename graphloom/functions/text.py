"""Column expressions over paths, source text and symbols. Nothing here needs Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def python_regex(pattern: str) -> str:
    """The pattern with Unicode classes, as Python's regular expressions have them."""
    return f"(?U){pattern}"


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# paths


def language(path: Column | str) -> Column:
    """Language by extension, null for others."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in fixed.LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"(?<=.)\.[^.]*$", "")


def is_test_path(path: Column | str) -> Column:
    """Decided on the path as given; callers pass paths relative to the root."""
    parts = F.split(F.lower(col(path)), "/")
    return F.arrays_overlap(parts, strings(fixed.TEST_PARTS)) | F.lower(stem(path)).rlike(fixed.TEST_STEM)


def excluded(path: Column | str, names: Sequence[str]) -> Column:
    """Whether a directory of the path has one of the names."""
    parts = F.split(col(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), strings(names))


def module_key(path: Column | str) -> Column:
    parts = F.split(col(path), "/")
    first = F.get(parts, F.lit(0))
    return F.when((F.size(parts) >= 3) & first.isin(*fixed.MODULE_ROOTS), F.concat_ws("/", first, F.get(parts, F.lit(1)))).when(F.size(parts) >= 2, first).otherwise("root")


def glob_match(path: Column | str, patterns: Sequence[str]) -> Column:
    """Whether the path or its last part matches a file name pattern (``*`` crosses slashes)."""
    import fnmatch

    name = F.substring_index(col(path), "/", -1)
    out = F.lit(False)
    for p in patterns:
        rx = fnmatch.translate(p).replace(r"\Z", r"\z")  # Java writes the very end so
        out = out | col(path).rlike(f"^(?:{rx})") | name.rlike(f"^(?:{rx})")
    return out


# hashes


def sha20(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 20)


def deps_hash(calls: Column | str, callers: Column | str) -> Column:
    """Of both lists in sorted order."""
    listed = lambda c: F.array_join(F.array_sort(col(c)), ",")
    return sha20(F.concat(listed(calls), F.lit("|"), listed(callers)))


def insight_key(version: str, content: Column | str, deps: Column | str) -> Column:
    return sha20(F.concat_ws("|", F.lit(version), col(content), col(deps)))


# symbols


def qualified(symbol_id: Column | str, name: Column | str) -> Column:
    return F.when(F.instr(col(symbol_id), "::") > 0, F.regexp_extract(col(symbol_id), r"(?s)^.*?::(.*)$", 1)).otherwise(col(name))


def parent_of(qualified_name: Column | str) -> Column:
    """What stands before the last dot, null without one."""
    q = col(qualified_name)
    return F.when(F.instr(q, ".") > 0, F.regexp_extract(q, r"(?s)^(.*)\.[^.]*$", 1))


def split_call(raw: Column | str) -> Column:
    """(tail, receiver) of a call expression: the last two dotted parts before the first bracket."""
    parts = F.filter(F.transform(F.split(F.trim(F.substring_index(col(raw), "(", 1)), r"\."), lambda x: F.trim(x)), lambda p: p != "")
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("tail"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("receiver"))


def strip_comments(body: Column | str, lang: Column | str) -> Column:
    """Without comments, for flag and complexity scans; quotes are not heeded."""
    python = F.regexp_replace(F.regexp_replace(col(body), r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'', ""), r"#[^\n]*", "")
    other = F.regexp_replace(F.regexp_replace(col(body), r"/\*[\s\S]*?\*/", ""), r"//[^\n]*", "")
    return F.when(col(lang) == "python", python).otherwise(other)


def capability_flags(body: Column | str, unicode: bool = True) -> Column:
    """Names of the patterns found, dynamic ones first, in fixed order."""
    rx = python_regex if unicode else (lambda p: p)
    found = [F.when(col(body).rlike(rx(p)), F.lit(f"dynamic:{n}")) for n, p in fixed.DYNAMIC_FLAGS]
    found += [F.when(col(body).rlike(rx(p)), F.lit(n)) for n, p in fixed.PLAIN_FLAGS]
    return F.array_compact(F.array(*found))


def is_dynamic(flags: Column | str) -> Column:
    return F.exists(col(flags), lambda f: f.startswith("dynamic:"))


def lexical_complexity(body: Column | str, unicode: bool = True) -> Column:
    pattern = python_regex(fixed.COMPLEXITY) if unicode else fixed.COMPLEXITY
    return F.least(F.lit(1) + F.regexp_count(col(body), F.lit(pattern)), F.lit(fixed.COMPLEXITY_CAP))


def occurrences(text: Column | str, token: str) -> Column:
    """Number of non-overlapping occurrences."""
    return ((F.char_length(col(text)) - F.char_length(F.replace(col(text), F.lit(token), F.lit("")))) / len(token)).cast("int")


def text_complexity(body: Column | str) -> Column:
    total = F.lit(1)
    for token in fixed.TEXT_COMPLEXITY:
        total = total + occurrences(body, token)
    return F.least(total, F.lit(fixed.TEXT_COMPLEXITY_CAP))


def unusual_logic(code: Column | str) -> Column:
    """Names of the unusual kinds of logic that a text's words suggest, in fixed order."""
    low, c = F.lower(col(code)), col(code)
    found = []
    for name, words in fixed.UNUSUAL_LOGIC:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        if words == ("fallback",):
            hit = hit | (F.contains(c, F.lit("try")) & F.contains(c, F.lit("except")))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def outbound_calls(code: Column | str, most: int = 10) -> Column:
    """The first distinct names that are called."""
    names = F.array_distinct(F.regexp_extract_all(col(code), F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1)))
    return F.slice(F.filter(names, lambda n: ~n.isin(*fixed.NOT_OUTBOUND)), 1, most)


# words


def clean(text: Column | str) -> Column:
    """No emoji, back quotes or asterisks; underscores and white space as one space."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{FE0F}]", "")
    return F.trim(F.regexp_replace(F.translate(plain, "_`*", " "), r"(?U)\s+", " "))


def clean_prose(text: Column | str) -> Column:
    """Like ``clean``, but underscores stay."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{FE0F}]", "")
    return F.trim(F.regexp_replace(F.translate(plain, "`*", ""), r"(?U)\s+", " "))


def identifier_words(name: Column | str) -> Column:
    return F.regexp_extract_all(col(name), F.lit(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0))


def first_words(text: Column | str, n: int = fixed.MICRO_WORDS) -> Column:
    return F.array_join(F.slice(F.filter(F.split(clean(text), " "), lambda w: w != ""), 1, n), " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def micro_label(doc: Column | str, name: Column | str, kind: Column | str) -> Column:
    """At most five words: the first sentence of the doc, else the name read as a phrase."""
    cleaned = clean(doc)
    head = F.regexp_replace(F.array_join(F.slice(F.filter(F.split(F.get(sentences(cleaned), F.lit(0)), " "), lambda w: w != ""), 1, fixed.MICRO_WORDS), " "), r"[.,:;]+$", "")
    from_doc = F.when(F.char_length(head) >= 5, F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1 << 20)))
    words = identifier_words(name)
    first, rest = F.get(words, F.lit(0)), F.slice(words, 2, 1 << 20)
    verbs = F.create_map(*[F.lit(x) for kv in fixed.VERBS.items() for x in kv])
    by_prefix = F.lit(None).cast("string")
    for prefix, verb in reversed(fixed.PREFIXES):
        by_prefix = F.when(col(name).startswith(prefix), verb).otherwise(by_prefix)
    verb = F.coalesce(by_prefix, F.try_element_at(verbs, F.lower(first)))
    capital = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 20))
    kept = F.concat(F.array(F.coalesce(verb, capital)), F.filter(rest, lambda w: ~F.lower(w).isin(*fixed.STOP_WORDS)))
    phrase = F.when(verb.isNull() & col(kind).isin("class", "interface", "type"), F.concat(F.lit("Type "), F.array_join(words, " "))).otherwise(F.array_join(kept, " "))
    return F.coalesce(from_doc, F.when(F.size(words) == 0, F.lit("Core routine")).otherwise(first_words(phrase)))


def why_sentence(doc, kind, file_path, line, fan_in, fan_out, complexity, flags, is_test) -> Column:
    """Two sentences of the doc where it has over 20 characters, else the facts."""
    cleaned = clean(doc)
    from_doc = F.when(F.char_length(cleaned) > 20, F.substring(F.array_join(F.slice(sentences(cleaned), 1, 2), " "), 1, 280))
    signals = F.slice(F.filter(col(flags), lambda f: ~f.startswith("filesystem")), 1, 4)
    facts = F.concat_ws(
        " ",
        F.format_string("%s defined in %s:%s.", F.initcap(col(kind)), col(file_path), col(line).cast("string")),
        F.format_string("Referenced by %s caller(s); invokes %s resolved symbol(s); complexity %s.", col(fan_in).cast("string"), col(fan_out).cast("string"), col(complexity).cast("string")),
        F.when(F.size(signals) > 0, F.concat(F.lit("Signals: "), F.array_join(signals, ", "), F.lit("."))),
        F.when(col(is_test), F.lit("Part of the test suite.")),
    )
    return F.coalesce(F.when(from_doc != "", from_doc), facts)


def policy_hit(prompt: Column | str, purpose: Column | str) -> Column:
    """The first refused phrase in prompt or purpose, null if there is none."""
    both = F.lower(F.concat_ws(" ", F.coalesce(col(prompt), F.lit("")), F.coalesce(col(purpose), F.lit(""))))
    return F.get(F.filter(strings(fixed.BUG_FIX + fixed.EXPLORATION), lambda p: F.contains(both, p)), F.lit(0))


# output


def html_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def percent(part: Column | str, whole: Column | str) -> Column:
    """A whole number of hundredths, halves to the even one; ``0%`` of nothing."""
    return F.when(col(whole) > 0, F.concat(F.bround(100.0 * col(part) / col(whole), 0).cast("long").cast("string"), F.lit("%"))).otherwise("0%")


def plural(n: Column | str, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", F.format_number(col(n), 0), F.when(col(n) == 1, one).otherwise(many or one + "s"))


def json_block(text: Column | str, schema: str) -> Column:
    """The JSON object from the first opening to the last closing brace."""
    return F.from_json(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), schema)


def shell_safe(text: Column | str, most: int = 4000) -> Column:
    """One line without control characters and quotes that a shell would read."""
    return F.substring(F.trim(F.regexp_replace(F.translate(col(text), "`$\\\"'", ""), r"[\x00-\x1f\x7f]+", " ")), 1, most)


def comment_prefix(path: Column | str) -> Column:
    """How a line comment begins in the file's language."""
    ext = F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1))
    slashes = (".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".rs", ".cs", ".swift", ".kt")
    return F.when(ext.isin(*slashes), "//").when(ext.isin(".sql", ".lua"), "--").otherwise("#")


def language_display(path: Column | str) -> Column:
    """The language's name as people write it, ``-`` for unknown ones."""
    names = {"python": "Python", "go": "Go", "typescript": "TypeScript", "javascript": "JavaScript"}
    own = language(path)
    out = F.lit("-")
    for k, v in names.items():
        out = F.when(own == k, v).otherwise(out)
    return out


def attribution(author: Column | str, pr_number: Column | str, commit: Column | str) -> Column:
    """The strongest source that the evidence supports."""
    source = provenance(pr_number, commit, "no linked pull request or commit")
    who = F.trim(F.coalesce(col(author), F.lit("")))
    return F.when(who != "", F.concat(F.lit("Authored by "), who, F.lit(" in "), source)).otherwise(F.concat(F.lit("Source: "), source))


def provenance(pr_number: Column | str, commit: Column | str, none: str = "No recorded history") -> Column:
    sha = F.trim(F.coalesce(col(commit), F.lit("")))
    return F.when(col(pr_number).isNotNull(), F.concat(F.lit("PR #"), col(pr_number).cast("string"))).when(sha != "", F.concat(F.lit("commit "), F.substring(sha, 1, 7))).otherwise(none)


def worth_looking_up(word: Column | str) -> Column:
    """Words of three letters or more that are no keywords."""
    return (F.char_length(col(word)) >= 3) & ~F.lower(col(word)).isin(*fixed.KEYWORDS)


def number_word(n: Column | str) -> Column:
    words = ["no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    return F.coalesce(F.get(strings(words), F.when(col(n).between(0, 10), col(n)).cast("int")), F.format_number(col(n), 0))


def counted(n: Column | str, noun: str) -> Column:
    """A small count in words, its noun in number."""
    return F.concat(number_word(n), F.lit(f" {noun}"), F.when(col(n) == 1, "").otherwise("s"))


def answer(prompt: Column | str, ladder: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """The answer of the first rung one of whose phrases the prompt holds, in any case."""
    low = F.lower(col(prompt))
    out = F.lit(otherwise)
    for phrases, text in reversed(ladder):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p.lower()))
        out = F.when(hit, text).otherwise(out)
    return out
