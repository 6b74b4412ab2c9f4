"""Registered masking queries (C1-C18) and their DuckDB twins."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F

from facsimile.operators import detect as D
from facsimile.operators import mask as M
from facsimile.operators import profile as P
from facsimile.operators.vault import KeptVault
from facsimile.plans.common import rounded
from facsimile.plans.oracle_profile import _lit, column_stats_sql
from facsimile.plans.profile_queries import STATS_COLS
from facsimile.plans.registry import add
from facsimile.plans.tables import PII_SQL, TABLE_COLUMNS, pii_customers, pii_sql, table
from facsimile.session import checkpoint_dir

KEY = "fixture-key-0001"

# The token type given to each column of the personal-data view.
PII_TYPES = {
    "c_name": "name",
    "c_mktsegment": "text",
    "contact_email": "email",
    "phone": "phone",
    "ssn_text": "ssn",
    "alt_contact": "email",
    "ref_code": "ssn",
    "dial": "phone",
    "dob": "date",
    "card": "credit_card",
}
PII_KINDS = [("c_custkey", "numeric"), ("c_name", "string"), ("c_mktsegment", "string")] + [(c, "string") for c in PII_SQL]


# ------------------------------------------------------------------ SQL twin

def _blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


def hmac_sql(message_sql: str, key: str = KEY) -> str:
    ipad, opad = M._pads(key.encode())
    inner = f"sha256({_blob(ipad)} || encode({message_sql}))"
    return f"sha256({_blob(opad)} || unhex({inner}))"


def _shift_sql(ch: str, off: str, classes) -> str:
    whens = []
    for cls in classes:
        base, size = {M.DIGITS: (48, 10), M.LOWER: (97, 26), M.UPPER: (65, 26)}[cls]
        whens.append(f"WHEN ascii({ch}) BETWEEN {base} AND {base + size - 1} THEN chr({base} + (ascii({ch}) - {base} + {off}) % {size})")
    return f"(CASE {' '.join(whens)} ELSE {ch} END)"


def _format_sql(v: str, tweak: str, classes) -> str:
    cls = "".join(classes)
    h = hmac_sql(f"'{tweak}:' || vv")
    off = "CAST(('0x' || substr(hx, ((k - 1) % 32) * 2 + 1, 2)) AS INTEGER)"
    moved = f"list_transform(string_split(mapped, ''), lambda ch, k: {_shift_sql('ch', off, classes)})"
    body = f"""(SELECT array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(moved[i], '')), '')
   FROM (SELECT string_split_regex(vv, '[{cls}]') AS gaps, {moved} AS moved
         FROM (SELECT vv, regexp_replace(vv, '[^{cls}]', '', 'g') AS mapped, {h} AS hx FROM (SELECT {v} AS vv))))"""
    return f"(CASE WHEN {v} = '' THEN {v} ELSE {body} END)"


def token_sql(v: str, data_type: str) -> str:
    tweak, classes = M.TOKEN_TYPES.get(data_type, M.TOKEN_TYPES[M.DEFAULT_TYPE])
    if data_type == "email":
        local = f"regexp_extract({v}, '^(.*)@([^@]*)$', 1)"
        domain = f"regexp_extract({v}, '^(.*)@([^@]*)$', 2)"
        return f"(CASE WHEN {v} IS NULL THEN NULL WHEN position('@' IN {v}) = 0 THEN {v} ELSE {_format_sql(local, tweak, classes)} || '@' || {domain} END)"
    return f"(CASE WHEN {v} IS NULL THEN NULL ELSE {_format_sql(v, tweak, classes)} END)"


def sensitive_sql(src: str, kinds: list[tuple[str, str]]) -> str:
    parts = []
    for pos, (c, kind) in enumerate(kinds):
        fired, typ = D.sensitive_by_name(c)
        if fired:
            t = _lit(typ)
        elif kind != "string":
            t = "NULL::VARCHAR"
        else:
            rates = []
            for vt, pat in D.SENSITIVE_VALUE_RULES:
                pat_sql = pat.replace("'", "''")
                rates.append(
                    f"WHEN avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '{pat_sql}') THEN 1 ELSE 0 END) > {D.SENSITIVE_MATCH_RATE} THEN '{vt}'"
                )
            t = f"(CASE {' '.join(rates)} END)"
        parts.append(f"SELECT {_lit(c)} AS \"column\", CAST({pos} AS INTEGER) AS position, CASE WHEN count({c}) > 0 THEN {t} END AS sensitive_type FROM {src}")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE sensitive_type IS NOT NULL"


# ------------------------------------------------------------------ queries

for _name, _src, _kinds in [
    ("pii_customers", pii_sql(), PII_KINDS),
    ("customer", "customer", TABLE_COLUMNS["customer"]),
    ("supplier", "supplier", TABLE_COLUMNS["supplier"]),
    ("part", "part", TABLE_COLUMNS["part"]),
    ("events", "events", TABLE_COLUMNS["events"]),
]:
    def _q(spark, sf_dir, _n=_name):
        df = pii_customers(spark, sf_dir) if _n == "pii_customers" else table(spark, sf_dir, _n)
        return D.sensitive_columns(df)

    add(f"mask_sensitive_columns_{_name}", _q, sensitive_sql(_src, _kinds))


def q_tokenize(spark, sf_dir):
    return M.tokenize(pii_customers(spark, sf_dir), PII_TYPES, KEY)


def _tokenize_sql() -> str:
    cols = ["c_custkey"] + [f"{token_sql(c, PII_TYPES[c])} AS {c}" for c, _ in PII_KINDS[1:]]
    return f"SELECT {', '.join(cols)} FROM {pii_sql()}"


add("mask_tokenize_pii_customers", q_tokenize, _tokenize_sql())

ORDER_TYPES = {"o_orderpriority": "alphanumeric", "o_orderdate": "date", "o_orderstatus": "name"}


def q_tokenize_distinct(spark, sf_dir):
    return M.tokenize(table(spark, sf_dir, "orders").select("o_orderkey", *ORDER_TYPES), ORDER_TYPES, KEY, strategy="distinct")


add(
    "mask_tokenize_distinct_orders",
    q_tokenize_distinct,
    "SELECT o_orderkey, "
    + ", ".join(f"{token_sql(f'CAST({c} AS VARCHAR)', t)} AS {c}" for c, t in ORDER_TYPES.items())
    + " FROM orders",
)


def q_tokenize_documents(spark, sf_dir):
    """Whole document texts, tokenized as alphanumeric text."""
    return M.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "text"}, KEY)


add("mask_tokenize_documents", q_tokenize_documents, f"SELECT doc_id, {token_sql('text', 'text')} AS text FROM documents")


def q_vault(spark, sf_dir):
    return M.token_vault(pii_customers(spark, sf_dir), PII_TYPES, KEY)


def _vault_sql() -> str:
    parts = [f"SELECT '{PII_TYPES[c]}' AS data_type, {c} AS value FROM {pii_sql()} WHERE {c} IS NOT NULL" for c, _ in PII_KINDS[1:]]
    pairs = "SELECT DISTINCT * FROM (" + "\nUNION ALL\n".join(parts) + ")"
    cases = " ".join(f"WHEN data_type = '{t}' THEN {token_sql('value', t)}" for t in sorted(set(PII_TYPES.values())))
    return f"SELECT data_type, value, CASE {cases} END AS token FROM ({pairs})"


add("mask_vault_pii_customers", q_vault, _vault_sql())


def _kept(spark, sf_dir) -> KeptVault:
    """A kept vault after a run on a part of the rows and one on all."""
    src = pii_customers(spark, sf_dir)
    vault = KeptVault(spark, f"facsimile_vault_{uuid.uuid4().hex[:12]}", f"{checkpoint_dir(spark).rstrip('/')}/vaults/{uuid.uuid4().hex}")
    vault.add(src.filter(F.col("c_custkey") % 3 == 0), PII_TYPES, KEY)
    vault.add(src, PII_TYPES, KEY)
    return vault


def q_kept_round_trip(spark, sf_dir):
    src = pii_customers(spark, sf_dir)
    return _kept(spark, sf_dir).detokenize(M.tokenize(src, PII_TYPES, KEY), PII_TYPES)


add("mask_vault_kept_pii_customers", lambda spark, sf_dir: _kept(spark, sf_dir).table(), _vault_sql())


def q_detokenize(spark, sf_dir):
    src = pii_customers(spark, sf_dir)
    masked = M.tokenize(src, PII_TYPES, KEY)
    return M.detokenize(masked, PII_TYPES, M.token_vault(src, PII_TYPES, KEY))


def _detok_sql() -> str:
    cols = ["t.c_custkey"]
    joins = []
    for i, (c, _) in enumerate(PII_KINDS[1:]):
        ty = PII_TYPES[c]
        joins.append(
            f"LEFT JOIN (SELECT token, min(value) AS orig, count(*) > 1 AS amb FROM vault WHERE data_type = '{ty}' GROUP BY token) r{i} ON r{i}.token = t.{c}"
        )
        cols.append(f"CASE WHEN t.{c} IS NULL THEN NULL ELSE coalesce(r{i}.orig, t.{c}) END AS {c}")
        cols.append(f"coalesce(r{i}.amb, false) AS {c}_ambiguous")
    return f"WITH vault AS ({_vault_sql()}), t AS ({_tokenize_sql()}) SELECT {', '.join(cols)} FROM t {' '.join(joins)}"


add("mask_detokenize_pii_customers", q_detokenize, _detok_sql())
add("mask_vault_kept_round_trip_pii_customers", q_kept_round_trip, _detok_sql())


def q_preview(spark, sf_dir):
    src = pii_customers(spark, sf_dir)
    cols = ["c_name", "contact_email", "card"]
    return M.preview(src, M.tokenize(src, PII_TYPES, KEY), ["c_custkey"], cols, 5)


def _preview_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", c_custkey, CAST({c} AS VARCHAR) AS original, {token_sql(c, PII_TYPES[c])} AS tokenized FROM {pii_sql()}"
        for c in ["c_name", "contact_email", "card"]
    ]
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT "column", original, tokenized, CAST(row AS INTEGER) AS row FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY c_custkey) AS row FROM ({inner})) WHERE row <= 5"""


add("mask_preview_pii_customers", q_preview, _preview_sql())


def q_profile_tokenized(spark, sf_dir):
    """C17: the tokenized table becomes the source of the profile."""
    src = pii_customers(spark, sf_dir)
    return rounded(P.column_stats(M.tokenize(src, PII_TYPES, KEY)).select(*STATS_COLS))


add(
    "mask_profile_tokenized_customers",
    q_profile_tokenized,
    column_stats_sql("pii_tokens", src=f"({_tokenize_sql()})", cols=PII_KINDS),
)

