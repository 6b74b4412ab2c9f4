"""Keyed format-preserving tokens as column expressions, plus a token vault.

Token of a value ``v`` with type tweak ``t`` (C3-C12):

* ``h = HMAC-SHA256(key, t + ":" + v)``, built from two ``sha2`` calls on
  binary (``sha2(opad || unhex(sha2(ipad || msg)))``);
* every ASCII digit / lower / upper letter of a class the type maps is moved
  forward inside its alphabet by byte ``h[k mod 32]``, where ``k`` counts
  mapped characters only; every other character stays.

The expression never walks characters one by one with a growing string:
the mapped characters are pulled out in order (``regexp_replace``), shifted
with ``transform`` using their index, and zipped back between the unmapped
gaps (``split`` on the class with limit -1). Linear in the value length.

The key lives only inside the expression; result tables never carry it.
Detokenizing needs the vault (C14/C15): the hash covers the whole value, so
a token cannot be inverted from the key alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.session import cut_lineage

# Per type, the HMAC tweak and the character classes moved.
DIGITS, LOWER, UPPER = "0-9", "a-z", "A-Z"
TOKEN_TYPES: dict[str, tuple[str, tuple[str, ...]]] = {
    "credit_card": ("cc", (DIGITS,)),
    "ssn": ("ssn", (DIGITS,)),
    "phone": ("phone", (DIGITS,)),
    "email": ("email", (LOWER, UPPER, DIGITS)),
    "name": ("name", (LOWER, UPPER)),
    "date": ("date", (DIGITS,)),
    "alphanumeric": ("alphanum", (LOWER, UPPER, DIGITS)),
    "text": ("alphanum", (LOWER, UPPER, DIGITS)),
}
DEFAULT_TYPE = "alphanumeric"
MIN_KEY_LENGTH = 8
NULL_SALTS = 1024  # tasks-worth of keys that rows with a null are spread over
BLOCK = 64


def check_key(secret_key: str) -> bytes:
    """The key must have at least 8 characters."""
    if not secret_key or len(secret_key) < MIN_KEY_LENGTH:
        raise ValueError("Secret key must be at least 8 characters")
    return secret_key.encode("utf-8")


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column as 64 hex characters."""
    ipad, opad = _pads(key)
    inner = F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(opad)), F.unhex(inner)), 256)


def _shift(ch: Column, offset: Column, classes: tuple[str, ...]) -> Column:
    code = F.ascii(ch)
    out = None
    for cls in classes:
        base, size = {DIGITS: (48, 10), LOWER: (97, 26), UPPER: (65, 26)}[cls]
        moved = F.chr(F.lit(base) + (code - F.lit(base) + offset) % F.lit(size))
        test = (code >= base) & (code < base + size)
        out = F.when(test, moved) if out is None else out.when(test, moved)
    return out.otherwise(ch)


def shift_chars(value: Column, hex_hash: Column, classes: tuple[str, ...]) -> Column:
    """C4: move every mapped character by the hash byte of its mapped index."""
    cls = "".join(classes)
    mapped = F.regexp_replace(value, f"[^{cls}]", "")
    chars = F.when(mapped == "", F.array().cast("array<string>")).otherwise(F.split(mapped, ""))

    def move(ch: Column, k: Column) -> Column:
        offset = F.conv(F.substr(hex_hash, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return _shift(ch, offset, classes)

    moved = F.transform(chars, move)
    gaps = F.split(value, f"[{cls}]", -1)
    return F.array_join(F.zip_with(gaps, F.concat(moved, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")


def _format_token(key: bytes, value: Column, tweak: str, classes: tuple[str, ...]) -> Column:
    h = hmac_hex(key, F.concat(F.lit(tweak + ":"), value))
    return F.when(value == "", value).otherwise(shift_chars(value, h, classes))


def token_expr(col: Column, data_type: str, secret_key: str) -> Column:
    """Token of a column by type; null stays null; values as text."""
    key = check_key(secret_key)
    tweak, classes = TOKEN_TYPES.get(data_type, TOKEN_TYPES[DEFAULT_TYPE])
    v = col.cast("string")
    if data_type == "email":
        parts = F.regexp_extract(v, r"(?s)^(.*)@([^@]*)$", 1), F.regexp_extract(v, r"(?s)^(.*)@([^@]*)$", 2)
        local = parts[0]
        token = F.concat(_format_token(key, local, tweak, classes), F.lit("@"), parts[1])
        return F.when(v.isNull(), F.lit(None).cast("string")).when(~v.contains("@"), v).otherwise(token)
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(_format_token(key, v, tweak, classes))


def token_column(col: Column, data_type: str, secret_key: str, engine: str = "auto") -> Column:
    """Token column by the chosen engine.

    ``"sql"``: the Catalyst expression (no Python; its per-character
    ``transform``/``zip_with`` lambdas are interpreted, not code-generated);
    ``"arrow"``: the Arrow-batched helper. Measured on 600,000 short values
    (local[8]): 34 s for the expression, 9 s for Arrow; on whole documents
    the gap is ~60x. ``"auto"`` therefore picks Arrow. Both engines give
    identical tokens (checked row by row in the tests).
    """
    if engine == "auto":
        engine = "arrow"
    if engine == "arrow":
        return token_udf(data_type, secret_key)(col.cast("string"))
    return token_expr(col, data_type, secret_key)


def tokenize(
    df: DataFrame,
    column_types: dict[str, str],
    secret_key: str,
    columns: list[str] | None = None,
    strategy: str = "rows",
    engine: str = "auto",
) -> DataFrame:
    """Replace listed columns by their tokens (missing columns skipped).

    ``strategy="rows"`` evaluates the expression on every row: no shuffle,
    no skew, linear in rows. ``strategy="distinct"`` tokenizes each distinct
    value once, writes the pairs and joins them back (one shuffle per column);
    cheaper when values repeat a lot. Nulls are spread over the tasks.
    """
    check_key(secret_key)
    wanted = [c for c in (columns or list(column_types)) if c in df.columns]
    if strategy == "rows":
        return df.withColumns(
            {c: token_column(F.col(f"`{c}`"), column_types.get(c, DEFAULT_TYPE), secret_key, engine) for c in wanted}
        )
    out = df
    for c in wanted:
        t = column_types.get(c, DEFAULT_TYPE)
        pairs = (
            df.select(F.col(f"`{c}`").cast("string").alias("_v"))
            .filter(F.col("_v").isNotNull())
            .distinct()
            .select("_v", token_column(F.col("_v"), t, secret_key, engine).alias("_t"))
        )
        out = _join_values(out, c, cut_lineage(pairs), "_v").withColumn(c, F.col("_t")).drop("_t")
    return out.select(*df.columns)


def _join_values(df: DataFrame, column: str, values: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined with ``values`` on the text of ``column`` (its key ``key``).

    A null has no partner; its rows get one of many salts instead of all
    meeting in one task. ``key`` stays as a column (null for null).
    """
    text = F.col(f"`{column}`").cast("string")
    salted = df.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn(
        "_salt", F.when(text.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    )
    right = values.withColumnRenamed(key, "_text").withColumn("_salt", F.lit(0).cast("long"))
    return salted.join(right, ["_text", "_salt"], "left").drop("_text", "_salt")


def token_vault(
    df: DataFrame, column_types: dict[str, str], secret_key: str, columns: list[str] | None = None, engine: str = "auto"
) -> DataFrame:
    """C14: mapping table (data_type, value, token) for every distinct value.

    One unpivot of the listed columns and one distinct: tokens are computed
    per distinct (type, value), never per row.
    """
    check_key(secret_key)
    wanted = [c for c in (columns or list(column_types)) if c in df.columns]
    if not wanted:
        return df.sparkSession.createDataFrame([], "data_type string, value string, token string")
    entries = [
        F.struct(F.lit(column_types.get(c, DEFAULT_TYPE)).alias("data_type"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in wanted
    ]
    pairs = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull()).distinct()
    types = sorted({column_types.get(c, DEFAULT_TYPE) for c in wanted})
    if engine in ("auto", "arrow"):
        token = typed_token_udf(types, secret_key)(F.col("data_type"), F.col("value"))
    else:
        token = None
        for t in types:
            e = token_expr(F.col("value"), t, secret_key)
            token = F.when(F.col("data_type") == t, e) if token is None else token.when(F.col("data_type") == t, e)
    return pairs.select("data_type", "value", token.alias("token"))


def detokenize(
    df: DataFrame, column_types: dict[str, str], vault: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Map tokens back to values through the vault.

    Unknown tokens come back unchanged. When two values share one token the
    smallest value is returned and ``<column>_ambiguous`` is true.
    """
    wanted = [c for c in (columns or list(column_types)) if c in df.columns]
    reverse = vault.groupBy("data_type", "token").agg(
        F.min("value").alias("_orig"), (F.count(F.lit(1)) > 1).alias("_amb")
    )
    reverse = cut_lineage(reverse)  # read once per column
    out = df
    for c in wanted:
        t = column_types.get(c, DEFAULT_TYPE)
        r = reverse.filter(F.col("data_type") == t).select(F.col("token").alias("_tok"), "_orig", "_amb")
        out = _join_values(out, c, r, "_tok")
        out = out.withColumn(c, F.coalesce(F.col("_orig"), F.col(f"`{c}`").cast("string")))
        out = out.withColumn(f"{c}_ambiguous", F.coalesce(F.col("_amb"), F.lit(False))).drop("_orig", "_amb")
    return out


def preview(original: DataFrame, masked: DataFrame, key_cols: list[str], columns: list[str], n: int = 5) -> DataFrame:
    """Side-by-side original/token, the first n rows per column by key.

    The n rows are taken first, and only they are joined and tokenized.
    """
    first = original.orderBy(*key_cols).limit(n)  # n rows, so broadcast is bounded
    masked = masked.join(F.broadcast(first.select(*key_cols)), key_cols, "left_semi")
    joined = F.broadcast(first).alias("o").join(masked.alias("m"), key_cols)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"o.`{c}`").cast("string").alias("original"), F.col(f"m.`{c}`").cast("string").alias("tokenized"))
        for c in columns
    ]
    long = joined.select(*[F.col(k) for k in key_cols], F.inline(F.array(*entries)))
    w = Window.partitionBy("column").orderBy(*key_cols)
    return long.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= n).drop(*key_cols)


# ------------------------------------------------------------ Arrow engine

BATCH_CHARS = 1 << 20  # characters shifted together


def token_batch(data_type: str, secret_key: str):
    """Tokens of a list of strings (same definition as ``token_expr``).

    Only the HMAC is computed per value. All characters of the list are one
    array of code points: which of them are mapped, their index among the
    mapped ones of their value, the hash byte for that index and the shift
    within their class are array operations. Values are taken in parts of
    bounded size, so whole documents are fine too.
    """
    import hmac as _hmac

    import numpy as np

    key = check_key(secret_key)
    tweak, classes = TOKEN_TYPES.get(data_type, TOKEN_TYPES[DEFAULT_TYPE])
    prefix = f"{tweak}:".encode()
    ranges = [{DIGITS: (48, 10), LOWER: (97, 26), UPPER: (65, 26)}[c] for c in classes]

    def shifted(values: list[str]) -> list[str]:
        codes = np.frombuffer("".join(values).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(v) for v in values])
        ends = np.cumsum(sizes)
        digests = np.frombuffer(b"".join(_hmac.digest(key, prefix + v.encode(), "sha256") for v in values), np.uint8).reshape(-1, 32)
        owner = np.repeat(np.arange(len(values)), sizes)
        mapped = np.zeros(len(codes), bool)
        for base, size in ranges:
            mapped |= (codes >= base) & (codes < base + size)
        seen = np.concatenate([[0], np.cumsum(mapped)])
        index = seen[:-1] - seen[ends - sizes][owner]
        offset = digests[owner, index % 32].astype(np.int64)
        out = codes.copy()
        for base, size in ranges:
            here = (codes >= base) & (codes < base + size)
            out[here] = base + (codes[here] - base + offset[here]) % size
        text = out.astype("<u4").tobytes().decode("utf-32-le")
        return [text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]

    def run(values: list[str | None]) -> list[str | None]:
        out = list(values)
        tails = {}
        part: list[int] = []
        held = 0

        def flush():
            if part:
                for i, token in zip(part, shifted([out[i] for i in part])):
                    out[i] = token + tails.pop(i, "")
                part.clear()

        for i, v in enumerate(values):
            if not v:
                continue
            if data_type == "email":
                if "@" not in v:
                    continue
                v, domain = v.rsplit("@", 1)
                out[i], tails[i] = v, "@" + domain
                if not v:
                    out[i] = tails.pop(i)
                    continue
            part.append(i)
            held += len(v)
            if held >= BATCH_CHARS:
                flush()
                held = 0
        flush()
        return out

    return run


def token_udf(data_type: str, secret_key: str):
    """Arrow-batched pandas UDF around ``token_batch``."""
    import pandas as pd

    tokens = token_batch(data_type, secret_key)

    def tok(s):
        return pd.Series(tokens([None if v is None or v != v else v for v in s]), index=s.index, dtype=object)

    tok.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(tok, "string")


def typed_token_udf(types: list[str], secret_key: str):
    """One UDF of (data_type, value) for values of several types."""
    import pandas as pd

    tokens = {t: token_batch(t, secret_key) for t in types}

    def tok(kind, value):
        out = pd.Series([None] * len(value), index=value.index, dtype=object)
        for t in kind.unique():
            here = kind == t
            out[here] = tokens[t](list(value[here]))
        return out

    tok.__annotations__ = {"kind": pd.Series, "value": pd.Series, "return": pd.Series}
    return F.pandas_udf(tok, "string")
