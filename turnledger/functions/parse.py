"""Bulk parsing: JSON objects out of model text, canonical base URLs, JSON paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.text import trim_ws


def _whole_json(text: Column) -> Column:
    """The JSON value that the whole text is, null when something follows it.

    The engine's parser stops after the first value, so the text is put into a list before its own
    hash: only a text that is one value leaves a list of two.
    """
    end = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), end, F.lit('"]')))
    last = F.try_variant_get(pair, "$[1]", "string")
    closed = (last == end) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(closed, F.try_variant_get(pair, "$[0]", "variant"))


def extract_json_objects(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``json`` and ``reason``: the one JSON object in a model's answer, or why there is none.

    Reasoning blocks are dropped and the first fenced block wins. The text itself is
    tried first, then the part between the outer braces, each as is and then with smart
    quotes and trailing commas repaired. Each stage is its own column, so no expression is
    evaluated twice.
    """
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    text, body, inner = F.col("_text"), F.col("_body"), F.col("_inner")
    staged = df.withColumn(
        "_text", trim_ws(F.regexp_replace(raw, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    ).withColumn(
        "_body", F.when(text.rlike(fence), trim_ws(F.regexp_extract(text, fence, 1))).otherwise(text)
    )
    start = F.instr(body, "{")
    end = F.length(body) - F.instr(F.reverse(body), "}") + 1
    has_inner = (start > 0) & (F.instr(body, "}") > 0) & (end > start)
    staged = staged.withColumn("_inner", F.when(has_inner, F.substr(body, start, end - start + 1)))

    def repaired(value: Column) -> Column:
        return F.regexp_replace(F.translate(value, "“”", '""'), r",\s*([}\]])", "$1")

    parsed = F.coalesce(
        *[_whole_json(t) for t in (body, repaired(body), inner, repaired(inner))]
    )
    staged = staged.withColumn("_v", parsed)
    open_block = text.rlike(r"(?i)^<think(?:ing)?>") & ~text.rlike(r"(?i)</think(?:ing)?>")
    reason = (
        F.when(open_block, "unterminated reasoning block")
        .when(body == "", "empty")
        .when(F.col("_v").isNull(), "not valid JSON")
        .when(F.col("_v").try_cast("map<string,variant>").isNull(), "not an object")
    )
    return (
        staged.withColumn("reason", reason)
        .withColumn("json", F.when(F.col("reason").isNull(), F.to_json("_v")))
        .drop("_text", "_body", "_inner", "_v")
    )


def canonical_base_url(raw: Column) -> Column:
    """Origin plus path of an http(s) URL, null when it is not one.

    Trailing slashes and a trailing ``/chat/completions`` go, a bare host gets ``/v1``,
    query and fragment are dropped, scheme and host are lower-cased, default ports removed.
    """
    text = trim_ws(raw)
    shape = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d*))?([^?#]*)"
    scheme = F.lower(F.regexp_extract(text, shape, 1))
    host = F.lower(F.regexp_extract(text, shape, 2))
    port = F.regexp_extract(text, shape, 3)
    default = F.when(scheme == "http", "80").otherwise("443")
    suffix = F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(text, shape, 4), "/+$", "")
    path = F.regexp_replace(path, "(?i)/chat/completions$", "")
    full = F.when(path == "", "/v1").otherwise(path)
    return F.when(text.rlike(shape), F.concat(scheme, F.lit("://"), host, suffix, full))


def path_exists(document: Column, path: Column) -> Column:
    """Whether ``a.b[0].c`` leads to a value that is not null in a JSON text column.

    A number names a member of an object or a place of an array, whichever is there.
    """
    dotted = F.regexp_replace(path, r"\[(\d+)\]", r".$1")
    parts = F.filter(F.split(dotted, r"\."), lambda p: p != "")

    def quoted(p: Column) -> Column:
        return F.concat(F.lit("['"), p, F.lit("']"))

    def step(value: Column, p: Column) -> Column:
        member = F.call_function("get_json_object", value, F.concat(F.lit("$"), quoted(p)))
        place = F.call_function("get_json_object", value, F.concat(F.lit("$["), p, F.lit("]")))
        return F.when(value.startswith("{"), member).when(p.rlike(r"^\d+$") & value.startswith("["), place)

    return F.aggregate(parts, F.trim(document), step).isNotNull()
