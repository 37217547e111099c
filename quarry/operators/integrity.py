"""Fingerprints, personal-data scans, encryption, masking and drift checks."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_list, long_form, name, numeric_columns, require, text_columns
from quarry.operators import ordered
from quarry.session import write_out

# The entities and the patterns that find them, and their score.
PII_PATTERNS = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "PHONE_NUMBER": r"\b(?:\+?(\d{1,3}))?[-. (]*(\d{3})[-. )]*(\d{3})[-. ]*(\d{4})\b",
}
PII_SCORE = 0.85

DIGEST_BITS = {"sha256": 256, "sha512": 512}


def fingerprint(df: DataFrame, algo: str = "sha256", salt: str = "", exclude: str | Sequence[str] = (),
                strict: bool = False) -> DataFrame:
    """One-row digest of the whole table, whatever its row order or partitioning; repeated rows count.

    Equal rows collapse to (digest, copies) first. Digests are then folded in three fixed levels by
    their leading hex digits, so a fold step sees about rows / 16^6 digests, then at most 4096, then 4096.
    """
    if algo not in DIGEST_BITS:
        raise ValueError("algo must be sha256 or sha512")
    left_out = as_list(exclude)
    require(df, *left_out)
    bits = DIGEST_BITS[algo]
    cols = [c for c in df.columns if c not in left_out]

    def part(c: str) -> Column:
        text = name(c).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    row = F.sha2(F.concat(F.lit(f"{len(salt)}:{salt}"), *[part(c) for c in cols]), bits)
    # digests travel as bytes, half the size of their text
    copies = df.select(F.unhex(row).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.lower(F.hex("d")))
    leaves = (
        copies.groupBy(F.substring("d", 1, 6).alias("p"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("d", F.lit("x"), F.col("n").cast("string")))), ","), bits).alias("d"))
    )
    middle = leaves.groupBy(F.substring("p", 1, 3).alias("p")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", F.lit(":"), "d"))), ","), bits).alias("d"))
    shape = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in cols) if strict else ""
    return middle.agg(
        F.sha2(F.concat(F.lit(shape + "|"), F.array_join(F.sort_array(F.collect_list(F.concat("p", F.lit(":"), "d"))), ",")), bits)
        .alias("fingerprint"))


def verify_fingerprint(df: DataFrame, expected: str, salt: str = "", exclude: str | Sequence[str] = (),
                       strict: bool = False) -> DataFrame:
    """(algo, expected, actual, verified); the length of ``expected`` tells the algorithm."""
    algo = {64: "sha256", 128: "sha512"}.get(len(expected))
    if algo is None:
        raise ValueError("expected must be a SHA-256 or SHA-512 hex digest")
    return fingerprint(df, algo, salt, exclude, strict).select(
        F.lit(algo).alias("algo"), F.lit(expected).alias("expected"), F.col("fingerprint").alias("actual"),
        (F.col("fingerprint") == F.lit(expected)).alias("verified"))


def scan_pii(df: DataFrame, key: str | Sequence[str], entities: str | Sequence[str] | None = None,
             confidence: float = 0.5, cols: str | Sequence[str] | None = None) -> DataFrame:
    """Every match in every text column as (key…, column, entity, match_no, snippet); one scan, no shuffle."""
    keys = as_list(key)
    texts = as_list(cols) or [c for c in text_columns(df) if c not in keys]
    require(df, *keys, *texts)
    wanted = as_list(entities) or list(PII_PATTERNS)
    chosen = {e: p for e, p in PII_PATTERNS.items() if e in wanted and confidence <= PII_SCORE}
    cells = long_form(df, texts, keys, as_type="string")
    if not chosen:
        return cells.select(*map(name, keys), "column", F.lit("").alias("entity"), F.lit(0).alias("match_no"), F.col("value").alias("snippet")).limit(0)
    def matches(entity: str, pattern: str) -> Column:
        # (?U): letters, digits and word boundaries in the Unicode sense
        found = F.regexp_extract_all("value", F.lit("(?U)" + pattern), F.lit(0))
        return F.transform(found, lambda s, i: F.struct(F.lit(entity).alias("entity"), i.alias("match_no"), s.alias("snippet")))

    hits = F.flatten(F.array(*[matches(e, p) for e, p in chosen.items()]))
    return cells.select(*map(name, keys), "column", F.inline(hits))


def _key(df: DataFrame, key: bytes | str) -> Column:
    """The key as a one-row subquery: its value is no part of the plan, so neither explain nor the event log shows it."""
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return df.sparkSession.createDataFrame([(bytearray(raw),)], "k binary").scalar()


def key_from_file(path: str) -> bytes:
    """The key in a file on the driver; a new random one is stored there when the file does not exist."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        key = secrets.token_bytes(32)
        with open(path, "xb") as f:
            f.write(key)
        return key


def encrypt_col(df: DataFrame, col: str, key: bytes | str) -> DataFrame:
    """Authenticated encryption (AES-GCM) to Base64 text; null stays null."""
    require(df, col)
    return df.withColumn(col, F.base64(F.aes_encrypt(name(col).cast("string"), _key(df, key), F.lit("GCM"))))


def decrypt_col(df: DataFrame, col: str, key: bytes | str) -> DataFrame:
    """Reverse of ``encrypt_col``; a value that is not encrypted with this key comes back unchanged."""
    require(df, col)
    raw = F.try_to_binary(name(col), F.lit("base64"))
    plain = F.try_aes_decrypt(raw, _key(df, key), F.lit("GCM")).cast("string")
    return df.withColumn(col, F.coalesce(plain, name(col)))


def anonymize(df: DataFrame, col: str, method: str = "mask", chars: int = 4) -> DataFrame:
    """Mask the first characters, hash with SHA-256, or replace by [REDACTED]."""
    require(df, col)
    text = name(col).cast("string")
    if method == "mask":
        hidden = F.least(F.lit(chars), F.length(text))
        return df.withColumn(col, F.concat(F.repeat(F.lit("*"), hidden), F.substring(text, F.lit(chars + 1), F.length(text))))
    if method == "hash":
        return df.withColumn(col, F.sha2(text, 256))
    if method == "redact":
        return df.withColumn(col, F.lit("[REDACTED]"))
    raise ValueError("method must be mask, hash or redact")


def kolmogorov_tail(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic probability of a larger two-sample Kolmogorov–Smirnov distance."""
    n, m = n.cast("double"), m.cast("double")  # the product of counts leaves the range of long
    lam = distance * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def drift_check(current: DataFrame, baseline: DataFrame, threshold: float = 0.05,
                rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """Two-sample KS test per shared numeric column: (column, statistic, p_value, result).

    Both sides collapse to distinct values with two counts; the distribution functions are running
    totals over value ranges. All columns share one pass.
    """
    cols = [c for c in numeric_columns(current) if c in baseline.columns]
    require(baseline, *cols)
    both = long_form(current, cols).withColumn("side", F.lit(0)).unionByName(long_form(baseline, cols).withColumn("side", F.lit(1)))
    counts = write_out(both.groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")))
    run = ordered.running_total(counts, {"fa": F.col("a"), "fb": F.col("b")}, ["value"], ["column"], rows_per_range)
    gap = F.abs(F.try_divide(F.col("fa"), F.col("fa_all")) - F.try_divide(F.col("fb"), F.col("fb_all")))
    per = run.groupBy("column").agg(F.max(gap).alias("statistic"), F.max("fa_all").alias("n"), F.max("fb_all").alias("m"))
    names = current.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    tested = names.join(per, "column", "left").withColumn(
        "p_value", F.when(F.col("statistic").isNotNull(), kolmogorov_tail(F.col("statistic"), F.col("n"), F.col("m"))))
    return tested.select(
        "column", "statistic", "p_value",
        F.when(F.col("statistic").isNull(), "insufficient").when(F.col("p_value") < threshold, "DRIFT").otherwise("OK").alias("result"))
