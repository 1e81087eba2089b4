r"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Matches of the fixed patterns seed the extraction, and so do words that are secrets by their form
(``SECRET``: long hexadecimal numbers). Every identifier-like word (one with a digit or an ``@``) or
run of numbers is an instance. Its lexical contexts are the word before it, the two words before it,
the word after it, and the words on both sides, each with a slot of a coarse class (``a@a``, ``@``,
``9`` or ``a9``). Contexts and instance values form a bipartite graph that Spark scores in rounds. A
context's belief is the share of trusted values among those that it introduces, with ``DOUBT`` added
to their number; it counts from ``LEAST_SEEDS`` trusted values on. A value is trusted if it is a seed
or stands in a context with a belief of at least ``LEAST_SCORE``. Trust only grows, so the rounds end
when one adds no context. What trusted contexts introduce and the fixed patterns miss becomes a span
of kind ``id``; a secret without a trusted context does not.

Only DataFrame functions are used. Spark's regular expressions give matches but no places, so a
text's matches are paired with the gaps between them (``split`` on the same pattern) and a running
sum over lengths places them. That happens once for each distinct text with digits, ``@`` or ``+``,
and hot contexts are aggregated before they are shuffled.

The quantifiers are possessive, which Java runs without recursion: long digit runs don't overflow the
stack. Null texts count as empty and have no spans; repeated rows have equal ones. An empty table
gives an empty result. Only identifier and text are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import SPACE, materialize, text_or_empty

LEAST_SCORE = 0.8
LEAST_SEEDS = 5
DOUBT = 1.0
#: Secrets by their form: at least 32 hexadecimal digits, letters and figures.
SECRET = r"^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+$"

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The four patterns in an equal form that Java matches in linear time; ``\G`` lets a match begin where the last one ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to be searched for a kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
KINDS = ("email", "ip", "card", "phone", "id")
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_OUTER = r"\"')\]>}!.,;:#*$%&|"
#: A run of numbers, or a word with a digit or ``@``.
_IDENTIFIER = (
    r"(?<![^\x20\x09-\x0D])(?:[(+]*+[0-9][0-9().-]*+(?:\x20[(]?+[0-9][0-9().-]*+)++[\"'\]>},;:!?]*+(?![^\x20\x09-\x0D])"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: Places are joined by parts of a text of this many characters, so that long texts don't pair everything with everything.
_PART = 1000


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes Luhn's check."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).try_cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 == 0 else d)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


#: Words of more characters are compared by their hash.
_LONG = 80
_TAIL = 200


def _short(word: Column) -> Column:
    """A word in lower case, or its hash if it is long, with letters only if the word has some."""
    low = F.lower(word)
    digest = F.md5(low)
    return F.when(F.length(low) <= _LONG, low).when(low.rlike(r"\p{L}"), F.concat(F.lit("w"), digest)).otherwise(F.translate(digest, "abcdef", "012345"))


def _words_before(gap: Column) -> Column:
    """The last two whole words of a text; only a text whose end has no two whole words is searched farther than that."""
    tail = F.substring(gap, -_TAIL, _TAIL)
    near = F.when((F.length(gap) <= _TAIL) | ~tail.rlike(r"[\x20\x09-\x0D][^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$"), gap).otherwise(tail)
    start, word, space = r"(?<![^\x20\x09-\x0D])", r"([^\x20\x09-\x0D]++)", r"[\x20\x09-\x0D]"
    last = F.regexp_extract(near, rf"{start}{word}{space}*+$", 1)
    second = F.regexp_extract(near, rf"{start}{word}{space}++[^\x20\x09-\x0D]++{space}*+$", 1)
    return F.concat_ws(" ", F.nullif(_short(second), F.lit("")), F.nullif(_short(last), F.lit("")))


def _word_after(gap: Column) -> Column:
    """The first word of a text that begins with space, without punctuation after it."""
    head = F.substring(gap, 1, _TAIL)
    near = F.when((F.length(gap) <= _TAIL) | ~head.rlike(r"^[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]"), gap).otherwise(head)
    word = F.regexp_extract(near, r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)", 1)
    return F.concat(F.lit(" "), _short(F.regexp_replace(word, rf"(?<![{_OUTER}])[{_OUTER}]++$", "")))


def placed(texts: DataFrame, pattern: str) -> DataFrame:
    """Matches with their places: ``print``, ``match``, ``last`` and ``next`` (the two whole words before and the one after it, up to other matches), ``start``, ``end``."""
    # a text has one gap more than matches, so the last row of a text has no match
    both = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))
    rows = texts.select("print", F.posexplode(both).alias("k", "m"))
    # from here on only short strings travel
    rows = rows.select("print", "k", F.length("m.gap").alias("gap"), _word_after(F.col("m.gap")).alias("first"), _words_before(F.col("m.gap")).alias("last"), "m.match")
    w = Window.partitionBy("print").orderBy("k")
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    rows = rows.select("print", "last", "match", F.lead("first").over(w).alias("next"), end.alias("end")).filter("match IS NOT NULL")
    return rows.withColumn("start", F.col("end") - F.length("match"))


def base_spans(texts: DataFrame) -> DataFrame:
    """``print``, ``kind`` (its number), ``start``, ``end`` of the fixed patterns' valid matches."""
    found = []
    for i, kind in enumerate(KINDS[:4]):
        hit = placed(texts.filter(F.col("text").rlike(HINTS[kind])), PATTERNS[kind]).filter(valid(kind, F.col("match")))
        found.append(hit.select("print", F.lit(i).alias("kind"), "start", "end"))
    return reduce(DataFrame.unionByName, found)


def instances(texts: DataFrame) -> DataFrame:
    """Identifier-like words and runs of numbers without outer punctuation: place, hash of the value, and contexts."""
    words = placed(texts.filter(F.col("text").rlike("[0-9@]")), _IDENTIFIER)
    lead = F.length(F.regexp_extract("match", r"^[\"'(\[<{!.,;:#*$%&|]*+", 0))
    core = F.regexp_extract("match", rf"^[\"'(\[<{{!.,;:#*$%&|]*+(.*?)[{_OUTER}]*$", 1)
    rows = words.withColumn("value", core).withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length(core)).filter(F.length("value") >= 4)

    def parts(x: Column) -> Column:
        """The words around a value and its class; ``x``: value, left and right text."""
        value, left, right = x["value"], x["left"], x["right"]
        coarse = F.when(value.rlike("^[^@]++@[^@]++$"), "a@a").when(value.contains("@"), "@").when(value.rlike(r"\p{L}"), "a9").otherwise("9")
        before = F.regexp_extract(left, r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1)
        two_before = F.regexp_extract(left, r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*$", 1)
        after = F.regexp_replace(F.regexp_extract(right, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]*)", 1), rf"[{_OUTER}]+$", "")
        return F.struct(coarse.alias("class"), before.alias("before"), F.regexp_replace(two_before, SPACE + "+", " ").alias("two"), after.alias("after"))

    def contexts(x: Column) -> Column:
        """Signs alone are no words: '=' or '|' may only stand beside one."""
        word = {c: x[c].rlike(r"\p{L}") for c in ("before", "two", "after")}
        first = F.when(word["before"], F.concat_ws(" ", x["before"], x["class"], F.lit("")))
        second = F.when(word["two"], F.concat_ws(" ", x["two"], x["class"], F.lit("")))
        last = F.when(word["after"], F.concat_ws(" ", F.lit(""), x["class"], x["after"]))
        around = F.when((x["before"] != "") & (x["after"] != "") & (word["before"] | word["after"]), F.concat_ws(" ", x["before"], x["class"], x["after"]))
        return F.array_compact(F.array(first, second, last, around))

    # each step is worked out once: Spark would put the expressions of plain columns into one another
    around = F.struct("value", F.col("last").alias("left"), F.col("next").alias("right"))
    found = F.transform(F.transform(F.array(around), parts), contexts)
    return rows.select("print", "start", "end", F.md5("value").alias("value"), F.col("value").rlike(SECRET).cast("int").alias("secret"), found[0].alias("contexts"))


def seeded(words: DataFrame, base: DataFrame) -> DataFrame:
    """The instances with ``found``: 1 where they overlap a match of the fixed patterns, else 0."""

    def parts(start: str, end: str) -> Column:
        return F.explode(F.sequence((F.col(start) / _PART).cast("long"), ((F.col(end) - 1) / _PART).cast("long"))).alias("part")

    spans = base.select("print", F.col("start").alias("b_start"), F.col("end").alias("b_end"), parts("start", "end"))
    hit = words.select("print", "start", "end", parts("start", "end")).join(spans, ["print", "part"])
    hit = hit.filter((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))).select("print", "start", F.lit(1).alias("f")).distinct()
    return words.join(hit, ["print", "start"], "left").withColumn("found", F.coalesce("f", F.lit(0))).drop("f")


def believed(graph: DataFrame) -> DataFrame:
    """The contexts that enough trusted values support; ``graph``: context, value, trusted (0 or 1)."""
    found = graph.groupBy("context").agg(F.sum("trusted").alias("support"), F.count(F.lit(1)).alias("values"))
    return found.filter((F.col("support") >= LEAST_SEEDS) & (F.col("support") / (F.col("values") + DOUBT) >= LEAST_SCORE)).select("context")


def bootstrap(words: DataFrame, base: DataFrame) -> DataFrame:
    """Spans of values that trusted contexts introduce and the fixed patterns miss."""
    known = materialize(seeded(words, base), "pii-known").select("print", "start", "end", "value", "secret", "found", F.explode("contexts").alias("context"))
    edges = materialize(known.groupBy("context", "value").agg(F.max(F.greatest("found", "secret")).alias("seed")), "pii-edges")
    # a value is a seed wherever it occurs; contexts of too few values can never be trusted
    seeds = edges.groupBy("value").agg(F.max("seed").alias("trusted"))
    usable = edges.groupBy("context").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= LEAST_SEEDS).select("context")
    graph = materialize(edges.select("context", "value").join(usable, "context").join(seeds, "value"), "pii-graph")
    contexts, n = materialize(believed(graph), "pii-contexts"), 0
    while (now := contexts.count()) > n:
        n = now
        promoted = graph.filter("trusted = 0").join(contexts, "context", "left_semi").select("value", F.lit(1).alias("p")).distinct()
        trusted = F.greatest("trusted", F.coalesce("p", F.lit(0))).alias("trusted")
        graph = materialize(graph.join(promoted, "value", "left").select("context", "value", trusted), "pii-graph")
        contexts = materialize(believed(graph), "pii-contexts")
    return known.filter("found = 0").join(contexts, "context", "left_semi").select("print", F.lit(4).alias("kind"), "start", "end")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row the number of fixed matches of each kind, their digest, and all spans."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = keyed.withColumn("print", F.when(F.col("text").rlike("[0-9@]"), F.md5("text")))
    texts = materialize(keyed.filter("print IS NOT NULL").groupBy("print").agg(F.first("text").alias("text")), "pii-texts")
    base = materialize(base_spans(texts), "pii-base")
    spans = base.unionByName(bootstrap(instances(texts), base).distinct())
    one = F.struct("start", "kind", "end")
    fixed = F.filter(F.collect_list(one), lambda x: x["kind"] < 4)
    each = [F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    found = spans.groupBy("print").agg(*each, _listed(fixed).alias("fixed"), _listed(F.collect_list(one)).alias("spans"))
    columns = [
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.coalesce("fixed", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    ]
    # texts that were not searched have no key; they bypass the join, where all of them would meet in one task
    searched = keyed.filter("print IS NOT NULL").select("doc_id", "print").join(found, "print", "left")
    others = keyed.filter("print IS NULL").select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields])
    return searched.select(columns).unionByName(others.select(columns))


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
