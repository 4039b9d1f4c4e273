"""Pure Column expressions. Everything here stays inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, formats and synonym lists that results depend on.
UUID_PREFIX = r"^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"
UUID4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PARTICIPANT_PREFIX = "participant_"
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
]
APPROVE_WORDS = ["approve", "approved", "yes", "accept"]
REJECT_WORDS = ["reject", "rejected", "no"]
SKIP_WORDS = ["skip", "skipped", "n/a", ""]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int = 6) -> Column:
    """Round and normalise negative zero, for results that are compared across engines."""
    return F.round(_c(x), digits) + F.lit(0.0)


def align(tag) -> Column:
    """promotes = 1, violates = -1, neutral = 0; anything else is an error."""
    t = _c(tag)
    return (
        F.when(t == "promotes", 1)
        .when(t == "violates", -1)
        .when(t == "neutral", 0)
        .otherwise(
            F.raise_error(F.concat(F.lit("invalid tag: "), F.coalesce(t, F.lit("NULL")))).cast("int")
        )
    )


def binary_entropy(k, n) -> Column:
    """Entropy in bits of k out of n; 0 when n is 0 or the outcome is certain."""
    k, n = _c(k), _c(n)
    p = k.cast("double") / F.nullif(n, F.lit(0))
    return F.when((n == 0) | (k == 0) | (k == n), F.lit(0.0)).otherwise(
        -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    )


def participant_id(name, email) -> Column:
    """Stable anonymous id from a person's normalised name and e-mail."""
    key = F.concat(F.lower(F.trim(_c(name))), F.lit("|"), F.lower(F.trim(_c(email))))
    return F.concat(F.lit(PARTICIPANT_PREFIX), F.substring(F.sha2(key, 256), 1, 8))


def valid_participant_id(pid) -> Column:
    p = _c(pid)
    return p.startswith(PARTICIPANT_PREFIX) & (F.length(p) == len(PARTICIPANT_PREFIX) + 8)


def extract_case_uuid(header) -> Column:
    """Leading UUID of a survey column header, lower-cased, or NULL."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(_c(header)), UUID_PREFIX, 1)), F.lit(""))


def is_uuid4(x) -> Column:
    return _c(x).rlike(UUID4)


def case_id_from_filename(name) -> Column:
    """`case_<id>_<hash>.json` to `<id>`."""
    bare = F.replace(F.replace(_c(name), F.lit("case_"), F.lit("")), F.lit(".json"), F.lit(""))
    return F.split_part(bare, F.lit("_"), F.lit(1))


def normalise_email(email) -> Column:
    return F.lower(F.replace(_c(email), F.lit(" "), F.lit("")))


def valid_email(email) -> Column:
    return _c(email).rlike(EMAIL)


def parse_timestamp(text) -> Column:
    """First of the accepted survey formats that fits, as TIMESTAMP_NTZ, else NULL."""
    t = F.trim(_c(text))
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def match_choice(response, choice_1, choice_2) -> Column:
    """Which option text the response equals after trimming; NULL when neither."""
    r = F.trim(_c(response))
    return F.when(r == F.trim(_c(choice_1)), "choice_1").when(r == F.trim(_c(choice_2)), "choice_2")


def normalise_review_decision(decision) -> Column:
    d = F.lower(F.trim(F.coalesce(_c(decision), F.lit(""))))
    return (
        F.when(d.isin(APPROVE_WORDS), "approve")
        .when(d.isin(REJECT_WORDS), "reject")
        .when(d.isin(SKIP_WORDS), "skip")
        .otherwise("unknown")
    )


def json_string(text) -> Column:
    """The text as an ASCII JSON string literal with lower-case UTF-16 escapes.

    The writer's escapes have upper-case digits, so texts that contain any get them lowered; doubled
    backslashes are set aside meanwhile because a text may itself contain a backslash and a u.
    """
    t = _c(text)
    doc = F.to_json(F.struct(t.alias("s")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    body = F.substr(doc, F.lit(7), F.length(doc) - 8)
    aside = F.replace(F.replace(body, F.lit("\\\\"), F.lit("\x01")), F.lit("\x7f"), F.lit("\\u007f"))
    parts = F.split(aside, r"\\u")
    lowered = F.array_join(F.transform(parts, lambda p: F.concat(F.lower(F.substring(p, 1, 4)), F.substr(p, F.lit(5)))), "\\u")
    first = F.element_at(parts, 1)
    # the text before the first escape is not one
    fixed = F.concat(first, F.substr(lowered, F.length(first) + 1))
    out = F.when(F.contains(aside, F.lit("\\u")), F.replace(fixed, F.lit("\x01"), F.lit("\\\\"))).otherwise(
        F.replace(aside, F.lit("\x01"), F.lit("\\\\"))
    )
    return F.when(t.isNotNull(), F.concat(F.lit('"'), out, F.lit('"')))


def content_hash(vignette, choice_1: dict, choice_2: dict) -> Column:
    """First 12 hex digits of the SHA-256 of the case content as key-sorted JSON.

    Each option is a dict of field name to column (text under ``choice`` plus one per attribute).
    """

    def obj(fields: dict) -> Column:
        parts = []
        for i, key in enumerate(sorted(fields)):
            parts += [F.lit((", " if i else "{") + f'"{key}": '), fields[key]]
        return F.concat(*parts, F.lit("}"))

    option = lambda o: obj({k: json_string(v) for k, v in o.items()})
    doc = obj(
        {"choice_1": option(choice_1), "choice_2": option(choice_2), "vignette": json_string(vignette)}
    )
    return F.substring(F.sha2(doc, 256), 1, 12)


def case_file_name(case_id, digest) -> Column:
    """Content-addressed file name; a case without final content is a draft."""
    return F.concat(
        F.lit("case_"), _c(case_id), F.lit("_"), F.coalesce(_c(digest), F.lit("draft")), F.lit(".json")
    )


def case_text(vignette, choice_1, choice_2) -> Column:
    """The text that represents a case for embedding."""
    blank = lambda x: F.coalesce(_c(x), F.lit(""))
    return F.concat(
        blank(vignette), F.lit("\n\nChoice 1: "), blank(choice_1), F.lit("\n\nChoice 2: "), blank(choice_2)
    )


def option_text(variant) -> Column:
    """Option text of a VARIANT that is either an object with ``choice`` or a bare string."""
    v = _c(variant)
    return F.coalesce(
        F.try_variant_get(v, "$.choice", "string"),
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def display_name(rater, labels: dict[str, str], human_label: str = "Physician") -> Column:
    """Readable label: exact id, then short name, then anonymous person, then the last path part."""
    r = _c(rater)
    short = F.element_at(F.split(r, "/"), -1)
    table = F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv])
    code = F.get(F.split(short, "_"), F.lit(1))
    person = F.when(
        r.startswith("human/") & (F.length(code) > 0),
        F.concat(F.lit(human_label + " "), F.upper(F.substring(code, 1, 4))),
    )
    looked_up = [F.try_element_at(table, r), F.try_element_at(table, short)] if labels else []
    return F.coalesce(*looked_up, person, short)


def preview(text, n: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(
        F.coalesce(t, F.lit("N/A"))
    )


def pair_label(a, b) -> Column:
    na = F.lit("N/A")
    return F.concat(F.coalesce(_c(a), na), F.lit(" vs "), F.coalesce(_c(b), na))


def rater_slug(rater) -> Column:
    return F.replace(_c(rater), F.lit("/"), F.lit("-"))


def similarity_pct(similarity) -> Column:
    """Whole percent, truncated toward zero."""
    return (_c(similarity) * 100).cast("int")


def prompt_text(template, vignette, choice_1, choice_2) -> Column:
    """Fill the three slots of a template column."""
    out = _c(template)
    for slot, value in (("vignette", vignette), ("choice_1", choice_1), ("choice_2", choice_2)):
        out = F.replace(out, F.lit("{" + slot + "}"), _c(value))
    return out


def response_text(payload) -> Column:
    """Message body of a model payload, '' when absent."""
    return F.coalesce(
        F.try_variant_get(_c(payload), "$.choices[0].message.content", "string"), F.lit("")
    )


def response_meta(payload) -> list[Column]:
    """Model, creation time, token count and cost of a payload."""
    p = _c(payload)
    return [
        F.try_variant_get(p, "$.model", "string").alias("model"),
        F.try_variant_get(p, "$.created", "bigint").alias("created"),
        F.try_variant_get(p, "$.usage.total_tokens", "bigint").alias("total_tokens"),
        F.try_variant_get(p, "$.usage.cost", "double").alias("cost"),
    ]


def human_payload(pid, name, expertise, text, ts) -> Column:
    """Run payload of a survey response, shaped like a model payload's metadata."""
    t = _c(ts)
    return F.struct(
        F.lit("human").alias("type"),
        _c(pid).alias("participant_id"),
        _c(name).alias("participant_name"),
        _c(expertise).alias("participant_expertise"),
        _c(text).alias("response_text"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.unix_timestamp(t.cast("timestamp")).alias("created"),
    )


def option_class(promotes, violates) -> Column:
    """upside, downside, mixed or none, from whether an option promotes or violates anything."""
    p, v = _c(promotes), _c(violates)
    return (
        F.when(p & v, "mixed").when(p, "upside").when(v, "downside").otherwise("none")
    )


def hash_u32(*parts) -> Column:
    """Counter-based uniform 32-bit number: first 8 hex digits of the MD5 of the joined parts.

    The value depends on the parts alone, so draws are the same under any partitioning.
    """
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
