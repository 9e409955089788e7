"""Masking of secrets on their own origin and refusal elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text
from folioscan.sources.stored import stored

from . import spelled
from .sieve import sieve

MASK = "••••"
REFUSED = "[withheld: the text shows a secret of another site]"
GUARDED = 8
AHEAD = 32
PIECE = 4096
MOST_SECRETS = 10_000
MOST_BYTES = 8 << 20
MOST_PACKED = 32 << 20
BESIDE = 64  # bytes that a packed spelling takes beside its own
FEW = 256


def secret_forms(secrets: DataFrame) -> DataFrame:
    """(name, origin, value, forms) of (name, origin, value); empty values have no forms."""
    return secrets.where("value <> ''").withColumn("forms", text.spellings(F.col("value")))


def mask_forms(s: Column, forms: Column) -> Column:
    return F.aggregate(F.coalesce(forms, F.array().cast("array<string>")), s, lambda t, f: F.replace(t, f, F.lit(MASK)))


def _forms_by_start(secrets: DataFrame) -> DataFrame:
    """(_of, _form, _key): every spelling with its first GUARDED characters, all if it has fewer."""
    forms = secret_forms(secrets).select(F.col("origin").alias("_of"), F.explode("forms").alias("_form")).where("_form <> ''").distinct()
    return forms.withColumn("_key", F.substring("_form", 1, GUARDED))


def _pieces(s: Column) -> Column:
    """``s`` in pieces of PIECE characters, each with the AHEAD that follow."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{PIECE + AHEAD}}})).{{1,{PIECE}}}"), F.lit(1))


def _spots(s: Column, forms: DataFrame, meets: Callable[[Column], Column], ahead: int = GUARDED) -> Column:
    """(key, ahead) of the places in ``s`` where a spelling may begin: by their first GUARDED
    characters, and by as many as shorter spellings have. One pass gives the runs of ``s``."""
    sizes = sorted({GUARDED, *(n for (n,) in forms.where(F.char_length("_form") < GUARDED).select(F.char_length("_form")).distinct().collect())})  # GUARDED at most
    runs = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{ahead}}}))"), F.lit(1))
    start = lambda r, n: F.substring(r, 1, n)
    met = lambda n: F.transform(F.filter(runs, lambda r: meets(start(r, n))), lambda r: F.struct(start(r, n).alias("key"), r.alias("ahead")))
    return F.concat(*[met(n) for n in sizes])


def _longest_first(forms: Column) -> Column:
    return F.array_sort(forms, lambda a, b: F.when(F.octet_length(a) != F.octet_length(b), F.octet_length(b) - F.octet_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _held(df: DataFrame, forms: DataFrame, origin: str, hay: Column, mark: Column) -> DataFrame:
    """(_of, _mark, _held): for each origin and mark the spellings of the origin's secrets that
    stand in ``hay``, longest first. Texts meet the spellings on their first characters, so no
    row or task ever meets all secrets of an origin, and no text is shuffled: not by origin either,
    of which there may be few, each with most of all text in one task. Spellings with one
    beginning of AHEAD characters come together; one that the text lacks changes nothing."""
    meets, bound = sieve(forms.select("_of", "_key"), "_of", "_key"), sieve(forms.select("_of"), "_of")
    each = df.where(bound(F.col(origin))).select(F.col(origin).alias("_of"), mark.alias("_mark"), F.explode(F.flatten(F.transform(hay, _pieces))).alias("_s"))
    spots = each.select("_of", "_mark", F.explode(F.array_distinct(_spots(F.col("_s"), forms, lambda r: meets(F.col("_of"), r), AHEAD))).alias("_at"))
    spots = spots.select("_of", "_mark", F.col("_at.key").alias("_key"), F.col("_at.ahead").alias("_ahead")).distinct()
    near = spots.join(forms, ["_of", "_key"]).where(F.startswith("_ahead", F.substring("_form", 1, AHEAD))).select("_of", "_mark", "_form")
    dotted = forms.where(F.contains("_form", F.lit(MASK[0]))).select("_of", "_form")
    if dotted.limit(1).count():  # these may arise where a mask has been put
        near = near.unionByName(near.select("_of", "_mark").distinct().join(dotted, "_of"))
    return near.groupBy("_of", "_mark").agg(_longest_first(F.collect_set("_form")).alias("_held"))


def _packed(secrets: DataFrame) -> Broadcast | None:
    """All spellings of all origins to be broadcast, or None where they exceed MOST_PACKED bytes."""
    forms = _forms_by_start(secrets).where("_of is not null").select("_of", "_form")
    size = forms.agg(F.coalesce(F.sum(F.octet_length("_form") + BESIDE), F.lit(0))).first()[0]
    if size > MOST_PACKED:
        return None
    held = forms.toArrow()
    pairs = zip(held["_of"].to_pylist(), held["_form"].cast(pa.binary()).to_pylist(), strict=True)
    return secrets.sparkSession.sparkContext.broadcast(spelled.Spellings(pairs, MASK[0].encode()))


def mask_own(df: DataFrame, secrets: DataFrame, *, origin_col: str = "origin", text_cols: tuple[str, ...] = ("text",), attrs_col: str | None = None, type_col: str | None = None, value_col: str | None = None) -> DataFrame:
    """``df`` with every spelling of its origin's secrets masked in texts and attribute values,
    longest first, and every value of a password field masked whole.

    Secrets may be of any number, also of one origin: all together are looked for in one pass of
    Arrow batches, and no text is shuffled; beyond MOST_PACKED bytes they are joined to the texts.
    Null texts, rows of null origin and empty secrets stay as they are.
    """
    held = _packed(secrets)
    if held is None:
        out = _masked_by_joins(df, secrets, origin_col, text_cols, attrs_col)
    else:
        own, mask = F.col(origin_col), MASK.encode()
        one, each = spelled.masked(held, mask), spelled.masked_each(held, mask)
        new = {c: F.coalesce(one(own, F.col(c)), F.col(c)) for c in text_cols}
        if attrs_col:
            new[attrs_col] = F.map_from_arrays(F.map_keys(attrs_col), each(own, F.map_values(attrs_col)))
        out = df.select(origin_col, *[new.get(c, F.col(c)).alias(c) for c in df.columns if c != origin_col])
    if type_col and value_col:
        out = out.withColumn(value_col, F.when((F.lower(F.col(type_col)) == "password") & (F.col(value_col) != ""), F.lit(MASK)).otherwise(F.col(value_col)))
    return out


def _masked_by_joins(df: DataFrame, secrets: DataFrame, origin_col: str, text_cols: tuple[str, ...], attrs_col: str | None) -> DataFrame:
    """Up to FEW spellings of an origin are tried one after another; of origins with more, what a
    row's texts hold is found first, and that alone replaced."""
    hay = F.array(*[F.col(c) for c in text_cols])
    if attrs_col:
        hay = F.concat(hay, F.coalesce(F.map_values(attrs_col), F.array().cast("array<string>")))
    hay = F.filter(hay, lambda s: s != "")
    forms = _forms_by_start(secrets)
    by_origin = forms.groupBy("_of").agg(F.count("*").alias("n"), F.sum(F.octet_length("_form")).alias("bytes"))
    most, size = by_origin.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    many = by_origin.where(F.col("n") > FEW).select("_of")
    few = forms if most <= FEW else forms.join(many, "_of", "left_anti")
    lists = few.groupBy(F.col("_of").alias(origin_col)).agg(_longest_first(F.collect_list("_form")).alias("_forms"))
    out = df.join(F.broadcast(lists) if size <= MOST_BYTES else lists, origin_col, "left")
    if most > FEW:
        mark = F.sha2(F.array_join(F.transform(hay, lambda s: F.sha2(s, 256)), ""), 256)
        held = _held(df, forms.join(many, "_of", "left_semi"), origin_col, hay, mark).withColumnRenamed("_of", origin_col)
        out = out.withColumn("_mark", mark).join(held, [origin_col, "_mark"], "left").withColumn("_forms", F.coalesce("_held", "_forms")).drop("_held", "_mark")
    out = out.withColumns({c: mask_forms(F.col(c), F.col("_forms")) for c in text_cols})
    if attrs_col:
        out = out.withColumn(attrs_col, F.transform_values(attrs_col, lambda _, v: mask_forms(v, F.col("_forms"))))
    return out.drop("_forms")


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast where the table is small, else left to the optimizer."""
    return F.broadcast(small) if small.limit(MOST_SECRETS + 1).count() <= MOST_SECRETS else small


def shown_elsewhere(df: DataFrame, secrets: DataFrame, key: str, *, origin_col: str = "origin", text_col: str = "text") -> DataFrame:
    """(key) of rows whose text shows, in any spelling, a secret of another origin of at least
    GUARDED characters. Spellings are met in one pass over the texts, as in ``mask_own``."""
    long = secrets.where(F.char_length("value") >= GUARDED)
    held = _packed(long)
    if held is None:
        return _shown_by_joins(df, long, key, origin_col, text_col)
    return df.where(F.col(key).isNotNull() & spelled.shown(held)(F.col(origin_col), F.col(text_col))).select(key).distinct()


def _shown_by_joins(df: DataFrame, secrets: DataFrame, key: str, origin_col: str, text_col: str) -> DataFrame:
    """No list is gathered: every spelling of GUARDED characters or more begins with some GUARDED
    characters, so a text's runs of so many meet the spellings on their first ones. A spelling
    that is shorter than that (only cleaning can make it so) meets on itself. Runs that a filter
    of all beginnings rules out are never rows."""
    forms = _forms_by_start(secrets)
    starts = forms.select("_key").distinct()
    meets = sieve(starts, "_key")
    pieces = df.select(key, F.explode(_pieces(F.col(text_col))).alias("_s"))
    spots = pieces.select(key, F.explode(F.array_distinct(F.transform(_spots(F.col("_s"), forms, meets), lambda x: x["key"]))).alias("_key")).join(_sized(starts), "_key", "left_semi").distinct()
    near = spots.join(forms, "_key").join(df.select(key, origin_col, text_col), key)
    return near.where((F.col("_of") != F.col(origin_col)) & F.contains(text_col, "_form")).select(key).distinct()


def scrub(df: DataFrame, secrets: DataFrame, *, key: str = "doc_id", origin_col: str = "origin", text_col: str = "text") -> DataFrame:
    """``mask_own``, then whole texts refused where a secret of another origin of at least
    GUARDED characters still shows in any spelling. ``key`` tells rows apart; the keys of refused
    texts are written, and go to the texts unless they exceed MOST_BYTES."""
    masked = mask_own(df, secrets, origin_col=origin_col, text_cols=(text_col,))
    bad = stored(shown_elsewhere(masked, secrets, key, origin_col=origin_col, text_col=text_col), "refused")
    size = bad.agg(F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + 16), F.lit(0))).first()[0]
    bad = bad.withColumn("_bad", F.lit(True))
    shows = F.coalesce("_bad", F.lit(False))
    return masked.join(F.broadcast(bad) if size <= MOST_BYTES else bad, key, "left").withColumn("refused", shows).withColumn(text_col, F.when(shows, F.lit(REFUSED)).otherwise(F.col(text_col))).drop("_bad")


def archivable(sessions: DataFrame, *, session_col: str = "session_id", secret_col: str = "uses_secret", password_col: str = "typed_password") -> DataFrame:
    """Sessions that used no secret and typed no password."""
    return sessions.groupBy(session_col).agg(F.bool_or(F.coalesce(secret_col, F.lit(False)) | F.coalesce(password_col, F.lit(False))).alias("tainted")).where("not tainted").select(session_col)
