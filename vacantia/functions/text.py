"""Titles, locations, tokens and other text functions: Column in, Column out."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V


def _has_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def _first_rule(text: Column, rules: list[tuple]) -> Column:
    return F.coalesce(*[F.when(_has_any(text, needles), F.lit(value)) for value, needles in rules])


def normalize_space(c: Column) -> Column:
    """Unicode white space runs become one space, long dashes a hyphen, ends are trimmed."""
    plain = F.translate(c, "\u00a0\t\n\r\u2014\u2013", "    --")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def collapse_lower(c: Column) -> Column:
    """The form of a title that ingest compares: lower case, single spaces, dashes as they are."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def parse_title(c: Column) -> Column:
    """``struct(normalized, role_family, seniority, is_management)``; what the title doesn't say is null."""
    norm = normalize_space(F.lower(F.coalesce(c, F.lit(""))))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return F.struct(
        norm.alias("normalized"),
        _first_rule(padded, V.ROLE_FAMILY_RULES).alias("role_family"),
        _first_rule(padded, V.SENIORITY_RULES).cast("smallint").alias("seniority"),
        _has_any(padded, V.MANAGEMENT_NEEDLES).alias("is_management"),
    )


def _without_mode(fragment: Column) -> Column:
    prefix = f"^(?:{'|'.join(V.MODE_PREFIXES)})"
    rest = F.trim(F.btrim(F.trim(F.regexp_replace(fragment, prefix, "")), F.lit("-\u2013\u2014:()/,")))
    return F.trim(F.btrim(F.when(fragment.rlike(prefix), rest).otherwise(fragment), F.lit("-\u2013\u2014()")))


def country_code(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for code, names in V.COUNTRIES.items() for n in names for x in (n, code)])
    return F.element_at(table, name)


def capitalize_words(c: Column) -> Column:
    """Upper-case the first character of each word and leave the others."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def parse_location(c: Column) -> Column:
    """``struct(work_mode, country, city, geo_scope)``.

    Country is set only if the text names exactly one; the first unknown fragment counts as the city.
    A text that gives neither mode, country nor city gives no scope either.
    """
    s = normalize_space(F.lower(F.coalesce(c, F.lit(""))))
    fragments = F.filter(F.transform(F.split(s, "[,;|/]"), lambda x: _without_mode(F.trim(x))), lambda x: x != "")
    scope = F.array_sort(F.array_distinct(F.filter(F.transform(fragments, country_code), lambda x: x.isNotNull())))
    country = F.when(F.size(scope) == 1, F.get(scope, F.lit(0)))
    place = F.get(F.filter(fragments, lambda x: country_code(x).isNull()), F.lit(0))
    city = F.when(~place.isin(V.NOT_PLACES) & (F.octet_length(place) >= 2), capitalize_words(place))
    said = F.when(_has_any(s, V.HYBRID_HINTS), "hybrid").when(_has_any(s, V.REMOTE_HINTS), "remote")
    mode = F.coalesce(said, F.when(country.isNotNull() | city.isNotNull(), "onsite"))
    none = F.array().cast("array<string>")
    return F.struct(mode.alias("work_mode"), country.alias("country"), city.alias("city"), F.when(mode.isNull(), none).otherwise(scope).alias("geo_scope"))


def join_scope(scope: Column) -> Column:
    return F.nullif(F.array_join(scope, ","), F.lit(""))


def split_scope(scope: Column) -> Column:
    return F.when(F.coalesce(scope, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(scope, ","))


def board_work_mode(location: Column) -> Column:
    """What a board's location text says outright; remote outranks hybrid here, unlike in ``parse_location``."""
    low = F.lower(location)
    return F.when(low.contains("remote"), "remote").when(low.contains("hybrid"), "hybrid").otherwise("")


def language_code(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.octet_length(low) >= 2, F.substring(low, 1, 2)).otherwise("")


def parse_time(c: Column) -> Column:
    """Timestamps with an offset and plain dates; anything else is null."""
    text = F.trim(c)
    stamp = F.when(text.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d))?$"), text)
    return F.try_to_timestamp(stamp)


def strip_tags(c: Column) -> Column:
    """Every closing bracket of a tag, nested ones too, becomes a space; an unclosed tag swallows the rest; a stray ``>`` goes without a space.

    Only texts with brackets inside brackets are walked piece by piece, at any depth. What the walk gives
    is gathered in pieces of ``_PIECE`` bytes, so that no step copies all that was there before.
    """
    flat = F.replace(F.regexp_replace(F.regexp_replace(c, "<[^<>]*>", " "), "(?s)<.*$", ""), F.lit(">"), F.lit(""))

    def step(s: Column, p: Column) -> Column:
        depth = F.when(p == "<", s["depth"] + 1).when(p == ">", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        more = F.when((p == ">") & (s["depth"] > 0), " ").when(~p.isin("<", ">") & (s["depth"] == 0), p).otherwise("")
        full = F.octet_length(s["last"]) >= _PIECE
        return F.struct(depth.alias("depth"), F.when(full, F.array_append(s["out"], s["last"])).otherwise(s["out"]).alias("out"), F.when(full, more).otherwise(F.concat(s["last"], more)).alias("last"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))
    pieces = F.regexp_extract_all(c, F.lit("[<>]|[^<>]+"), F.lit(0))
    return F.when(c.rlike("<[^>]*<"), F.aggregate(pieces, start, step, lambda s: F.array_join(F.array_append(s["out"], s["last"]), ""))).otherwise(flat)


_PIECE = 4096


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(strip_tags(F.lower(F.coalesce(c, F.lit("")))), F.lit("[a-z0-9+#]+"), F.lit(0))


def title_tokens(c: Column) -> Column:
    """Tokens without stop words and single characters; all of them if none would remain."""

    def kept(tokens: Column) -> Column:
        found = F.filter(tokens, lambda t: ~t.isin(V.STOP_WORDS) & (F.length(t) > 1))
        return F.when(F.size(found) == 0, tokens).otherwise(found)

    return _let(tokenize(c), kept)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda Spark would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(c: Column) -> Column:
    """Three-word grams in order, repetitions too; shorter texts are one gram, empty ones none."""

    def grams(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 2, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(3)), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(found)

    return _let(tokenize(c), grams)


def block_key(company: Column, title: Column, country: Column) -> Column:
    first = F.array_join(F.slice(F.array_sort(title_tokens(title)), 1, 3), "-")
    return F.concat(company, F.lit("|"), first, F.lit("|"), F.upper(F.coalesce(country, F.lit(""))))


def normalize_url(c: Column) -> Column:
    """Host and path without scheme, query and one trailing slash; null if nothing comparable is left."""
    u = F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "^https://", ""), "^http://", "")
    u = F.regexp_replace(F.regexp_replace(u, "(?s)[?#].*$", ""), "/$", "")
    return F.when(u.contains("/"), u)


def clean_text(c: Column) -> Column:
    """Drop control characters; runs of space, tab, CR and LF become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), r"[\n\r\t ]+", " "))


def media_type(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def media_extension(c: Column) -> Column:
    """Extension of a supported resume format, else null."""
    kind = media_type(c)
    return F.when(kind == "application/pdf", ".pdf").when(kind == "text/plain", ".txt").when(kind == "text/markdown", ".md")


def content_hash(*parts: Column) -> Column:
    """SHA-256 in hex over the parts, each followed by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")).cast("binary"), zero)]), 256)


def seniority_label(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in V.SENIORITY_LABELS.items() for x in (k, v)]), c.cast("int"))


def seniority_level(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in V.SENIORITY_LABELS.items() for x in (v, k)]), label)


def json_map(c: Column) -> Column:
    """A JSON object as a map; anything malformed is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """HTML entities have no built-in; only texts with an ampersand cross to Python, in Arrow batches."""
    return F.when(c.contains("&"), F.pandas_udf(_unescape, "string")(c)).otherwise(c)
