"""Scalar functions as column expressions: null-safe arithmetic, text, dates, JSON, arrays. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CONFIDENT, KNOWN = 500, 200


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact(c: Column | str) -> Column:
    """A double as a decimal, so that its sums do not depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def total(c: Column | str) -> Column:
    """Sum that counts a missing measure as 0; 0 for no rows."""
    return F.coalesce(F.sum(F.coalesce(exact(c), F.lit(0).cast("decimal(18,4)"))), F.lit(0)).cast("double")


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d; null, never 0, where d is 0 or either is missing."""
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.try_divide(as_double(n), as_double(d))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def shrink(raw: Column, n: Column, overall: Column, prior: float) -> Column:
    """The raw value drawn towards the overall one, as if `prior` observations of that came on top."""
    return (raw * n + overall * prior) / (n + prior)


def decay(age: Column, half_life: float) -> Column:
    """0.5 ** (age / half_life); ages below 0 count as 0."""
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life)


def reciprocal_rank(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    """weight / (k + rank); 0 for a missing rank."""
    return F.coalesce(weight / (k + rank), F.lit(0.0))


def signs_differ(a: Column, b: Column, floor: float) -> Column:
    """Whether two values point different ways and either reaches the floor."""
    return (F.signum(a) != F.signum(b)) & ((F.abs(a) >= floor) | (F.abs(b) >= floor))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_similarity(cosine: Column) -> Column:
    """1 - d / 2 for the Euclidean distance d of unit vectors with this cosine."""
    return 1.0 - F.sqrt(F.greatest(2.0 - 2.0 * cosine, F.lit(0.0))) / 2.0


def confidence(n: Column, known: int = KNOWN, confident: int = CONFIDENT) -> Column:
    return F.when(n <= 0, "none").when(n < known, "low").when(n >= confident, "high").otherwise("medium")


def slug(c: Column, most: int = 48) -> Column:
    """Lower case, every run of other characters than letters a-z, Cyrillic ones and digits a hyphen, at most `most` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9а-яё]+", "-"), "^-+|-+$", ""), 1, most)


def snake(c: Column) -> Column:
    """camelCase and kebab-case names as snake_case."""
    return F.lower(F.replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), F.lit("-"), F.lit("_")))


def last_path_name(path: Column) -> Column:
    """The last step of a JSON path such as $.a[0].b that is a name."""
    steps = F.filter(F.split(F.regexp_replace(path, r"^\$\.?", ""), r"[.\[\]]+"), lambda s: (s != "") & ~s.rlike("^[0-9]+$"))
    return F.try_element_at(steps, F.lit(-1))


def citation_target(c: Column) -> Column:
    """A citation's path without a leading ./ or / and without :line."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^\.?/+", ""), r":[0-9]+(-[0-9]+)?$", "")


def citation_line(c: Column) -> Column:
    """The (first) line that a citation names, or null."""
    return F.nullif(F.regexp_extract(c, r":([0-9]{1,9})(-[0-9]+)?$", 1), F.lit("")).cast("int")


def snippet(c: Column, most: int = 240) -> Column:
    """White space collapsed; an ellipsis where the text is cut."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def context_key(c: Column, prefix: str = "de_") -> Column:
    """A name without its prefix, in lower case, letters and digits only."""
    low = F.lower(c)
    return F.regexp_replace(F.when(low.startswith(prefix), F.substring(low, len(prefix) + 1, 1 << 20)).otherwise(low), "[^a-z0-9]", "")


def first_sentence(c: Column, most: int = 200) -> Column:
    """Up to the first . ! or ? that a space or the end follows; an ellipsis where that is longer than `most`."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    found = F.regexp_extract(flat, r"^([^.!?]*(?:[.!?]+[^ .!?][^.!?]*)*[.!?]+)(?: |$)", 1)
    sentence = F.when(found == "", flat).otherwise(found)
    return F.when(F.length(sentence) > most, F.concat(F.rtrim(F.substring(sentence, 1, most)), F.lit("…"))).otherwise(sentence)


def request_key(path: Column, params: Column) -> Column:
    """path?k=v&... with encoded values, keys sorted, nulls left out; params is a map of strings."""
    kept = F.array_sort(F.map_entries(F.map_filter(params, lambda k, v: v.isNotNull())))
    query = F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def patched(old: Column, patch: Column, most: int = 20_000) -> Column:
    """Map `old` with the keys of `patch` set, or removed where the patch has an empty or null value; values are cut to `most`."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(patch, k))
    added = F.transform_values(F.map_filter(patch, lambda k, v: v.isNotNull() & (v != "")), lambda k, v: F.substring(v, 1, most))
    return F.map_concat(kept, added)


def resolved(path: Column) -> Column:
    """Struct (path, traversal, escapes): `.` and `..` steps taken, whether any .. stood there, whether it leaves the root."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("escapes"))

    def step(state: Column, s: Column) -> Column:
        at, none = state["at"], F.size(state["at"]) == 0
        up = F.struct(F.when(none, at).otherwise(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).alias("at"), (state["escapes"] | none).alias("escapes"))
        down = F.struct(F.concat(at, F.array(s)).alias("at"), state["escapes"].alias("escapes"))
        return F.when(s == "..", up).otherwise(down)

    end = F.aggregate(steps, start, step)
    return F.struct(F.array_join(end["at"], "/").alias("path"), F.array_contains(steps, "..").alias("traversal"), end["escapes"].alias("escapes"))


def alternation(alternatives: Column) -> Column:
    """A pattern for texts that contain one of the alternatives `a|b|c` as they stand, in any case; null for null or none."""
    each = F.filter(F.transform(F.split(alternatives, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    escaped = F.transform(each, lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$])", r"\\$1"))
    return F.when(F.size(escaped) > 0, F.concat(F.lit("(?i)"), F.array_join(escaped, "|")))


def globbed(path: Column, glob: str) -> Column:
    """Whether the whole path fits a pattern of * (any run, / too), ? (one character) and [sets]."""
    out, at = "", 0
    while at < len(glob):
        end = glob.find("]", at + 2) if glob[at] == "[" else -1
        if end > 0:
            out, at = out + "[" + glob[at + 1 : end].replace("\\", r"\\") + "]", end + 1
        else:
            out, at = out + {"*": "(?s:.*)", "?": "(?s:.)"}.get(glob[at], re.escape(glob[at])), at + 1
    return path.rlike(f"^{out}$")


def visible(status: Column, hidden: tuple[str, ...] = ("stub", "deprecated")) -> Column:
    """Whether a status is none of the hidden ones; a missing status is visible."""
    return status.isNull() | ~status.isin(*hidden)


def eligible(rounds: Column, floor: int = KNOWN) -> Column:
    """Whether a sample reaches the floor; a missing one does not."""
    return F.coalesce(rounds >= floor, F.lit(False))


def signed(c: Column, digits: int) -> Column:
    """A number with its sign (a minus sign, not a hyphen) and a fixed number of digits."""
    return F.concat(F.when(c >= 0, "+").otherwise("\u2212"), F.abs(F.round(c, digits)).cast(f"decimal(30,{digits})").cast("string"))


def typed_order(c: Column) -> list[Column]:
    """Sort keys of a text column that hold numbers and texts: numbers by value first, then texts; null counts as an empty text."""
    text = F.coalesce(c, F.lit(""))
    number = F.when(text.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"), text.try_cast("double"))
    return [number.isNull().asc(), number.asc(), text.asc()]


def strict_timestamp(c: Column) -> Column:
    """A text of the form YYYY-MM-DDThh:mm:ss[.fraction]Z as a timestamp; null if that is no time of the calendar."""
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?Z$"
    return F.when(c.rlike(form) & strict_date(F.substring(c, 1, 10)).isNotNull(), c.try_cast("timestamp"))


def canonical_json(c: Column) -> Column:
    """JSON text with the keys of all objects sorted and no white space, arrays as they are; null for what is no JSON. Arrow batches."""

    @pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            try:
                return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return canonical(c)


def strict_date(c: Column) -> Column:
    """A text of the form YYYY-MM-DD as a date; null if that is no day of the calendar."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date"))


def priority_date(*candidates: Column) -> Column:
    """The first candidate that is a strict date."""
    return F.coalesce(*[strict_date(c) for c in candidates])


def iso_week(c: Column) -> Column:
    """2024-W05 for a date: the ISO year and week."""
    return F.concat(F.extract(F.lit("yearofweek"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def normal_form(c: Column) -> Column:
    """Unicode NFKC; the one function here that needs Python (Arrow batches)."""

    @pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return nfkc(c)


def row_hash(*columns: str) -> Column:
    """SHA-256 of the row's columns, in the order of their names, as canonical JSON; nulls stay in as null."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
