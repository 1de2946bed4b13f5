"""Text, directive and formatting expressions (Column in, Column out; all run in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web documents count it.
SPACE = r"[\t\n\x0B\f\r\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"

# Robots directives that contradict each other, permissive first.
OPPOSITES = (
    ("index", "noindex"),
    ("follow", "nofollow"),
    ("archive", "noarchive"),
    ("snippet", "nosnippet"),
    ("translate", "notranslate"),
    ("imageindex", "noimageindex"),
)
# Header directives by effect, and those that take a parameter.
BLOCKING = ("noindex", "none")
RESTRICTIVE = ("nofollow", "noarchive", "nosnippet", "notranslate", "noimageindex", "unavailable_after")
PERMISSIVE = ("index", "follow", "all")
WITH_PARAMETER = ("max-image-preview", "max-snippet", "max-video-preview", "unavailable_after")


def collapse(value: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, SPACE, " "))


def clipped(value: Column, limit: int = 4096) -> Column:
    return F.substring(collapse(value), 1, limit)


def robots_value(value: Column) -> Column:
    """Lower-cased directives, sorted, joined by commas."""
    parts = F.transform(F.split(F.lower(value), "[;,]"), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), ",")


def strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _lookup(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def expanded(directives: Column, words: tuple[str, ...] = ("none", "all")) -> Column:
    """Distinct directives, none and all spelt out."""
    meaning = {"none": ("noindex", "nofollow"), "all": ("index", "follow")}

    def one(x: Column) -> Column:
        out = F.array(x)
        for w in words:
            out = F.when(x == w, strings(meaning[w])).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(directives, one)))


def with_meaning(directives: Column, word: str) -> Column:
    """Distinct directives; where `word` (none or all) is among them, what it means is added to it."""
    meaning = {"none": ("noindex", "nofollow"), "all": ("index", "follow")}[word]
    distinct = F.array_distinct(directives)
    return F.when(F.array_contains(distinct, word), F.array_union(distinct, strings(meaning))).otherwise(distinct)


def effective_directives(directives: Column) -> Column:
    """none and all spelt out; a restrictive directive beats its permissive opposite."""
    found, stricter = expanded(directives), _lookup(OPPOSITES)
    return F.filter(found, lambda x: ~F.coalesce(F.array_contains(expanded(directives), stricter[x]), F.lit(False)))


def has_opposites(directives: Column) -> Column:
    stricter = _lookup(OPPOSITES)
    return F.exists(expanded(directives), lambda x: F.coalesce(F.array_contains(expanded(directives), stricter[x]), F.lit(False)))


def loosened(strict: Column, loose: Column) -> Column:
    """Whether `loose` permits what `strict` forbids."""
    stricter = _lookup(OPPOSITES)
    return F.exists(loose, lambda x: F.coalesce(F.array_contains(strict, stricter[x]), F.lit(False)))


def robots_header(value: Column) -> Column:
    """array<struct<scope, directive>> of a robots header; a scope holds until the next one is named."""
    parts = F.filter(F.transform(F.split(F.lower(value), ","), lambda x: F.trim(x)), lambda x: x != "")

    def step(state: Column, part: Column) -> Column:
        name = F.trim(F.substring_index(part, ":", 1))
        plain = ~F.contains(part, F.lit(":")) | name.isin(*WITH_PARAMETER)
        scope = F.when(plain, state["scope"]).otherwise(name)
        rest = F.trim(F.regexp_replace(part, r"^[^:]*:\s*", ""))
        directive = F.when(plain & name.isin(*WITH_PARAMETER), name).when(plain, part).otherwise(rest)
        item = F.struct(scope.alias("scope"), directive.alias("directive"))
        return F.struct(scope.alias("scope"), F.concat(state["items"], F.array(item)).alias("items"))

    start = F.struct(
        F.lit(None).cast("string").alias("scope"),
        F.array().cast("array<struct<scope:string,directive:string>>").alias("items"),
    )
    return F.aggregate(parts, start, step, lambda s: s["items"])


def header_applies(scope: Column, agent: Column, user_agent: Column) -> Column:
    return scope.isNull() | (scope == F.lower(agent)) | F.contains(F.lower(user_agent), scope)


def audience_of(agent: Column) -> Column:
    key = F.lower(F.trim(agent))
    return F.when(key.isin("googlebot", "bingbot"), key).otherwise("robots")


def first_values(values: Column) -> Column:
    """At most three values of at most 160 characters, and how many more; <missing> for none."""
    some = F.array_join(F.transform(F.slice(values, 1, 3), lambda x: F.substring(x, 1, 160)), ", ")
    more = F.when(F.size(values) > 3, F.concat(F.lit(", +"), (F.size(values) - 3).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(values) == 0, "<missing>").otherwise(F.concat(some, more))


def rounded(value: Column, places: int = 2) -> Column:
    """Half up on the scaled value, as a browser's rounding does."""
    return F.floor(value * 10**places + 0.5) / 10**places


def json_number(value: Column) -> Column:
    """250 rather than 250.0."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def milliseconds(value: Column) -> Column:
    return F.when(value.isNull(), "-").when(value < 1000, F.format_string("%d ms", F.floor(value + 0.5).cast("bigint"))).otherwise(
        F.format_string("%.2f s", value / 1000)
    )


def shortened(value: Column, limit: int) -> Column:
    """One line of at most `limit` characters, an ellipsis at the end of what was cut."""
    line = collapse(value)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("\u2026")))


def size_text(value: Column) -> Column:
    return (
        F.when(value < 1024, F.format_string("%d B", value))
        .when(value < 1024 * 1024, F.format_string("%.1f KiB", value / 1024.0))
        .otherwise(F.format_string("%.1f MiB", value / 1048576.0))
    )


def title_of(code: Column) -> Column:
    """A code as words: first letter upper-case, dashes as blanks."""
    words = F.regexp_replace(code, "-", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def markdown_cell(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def xml_text(value: Column) -> Column:
    """Escaped for XML and HTML; characters that XML 1.0 does not allow are left out."""
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}\x{D800}-\x{DFFF}]", "")


def json_string(value: Column) -> Column:
    """A text as JSON writes it, in quotes."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def annotation_text(value: Column) -> Column:
    """Escapes for a line-based annotation format."""
    out = value
    for raw, safe in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def annotation_property(value: Column) -> Column:
    """annotation_text for a property, where colons and commas separate."""
    return F.replace(F.replace(annotation_text(value), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def printable(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x1F\x7F-\x9F]", "?")


def real_date(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def glob_pattern(glob: str) -> str:
    """A regular expression for * and ? wildcards; without any, a substring."""
    import re

    if not any(c in glob for c in "*?"):
        return re.escape(glob)
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"
