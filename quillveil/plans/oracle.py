"""SQL text builders for the registered queries."""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(table: str, key: str, text: str, pattern: str, keep: str = "true") -> str:
    """key, start, end, value of all matches that satisfy ``keep`` (on ``value``), offsets in code points."""
    p = quoted(pattern)
    return f"""
SELECT {key}, CAST(g + w - length(value) AS INT) AS "start", CAST(g + w AS INT) AS "end", value FROM (
  SELECT {key}, ms[i] AS value,
    list_sum(list_transform(gs[1:i], lambda x: length(x))) AS g,
    list_sum(list_transform(ms[1:i], lambda x: length(x))) AS w
  FROM (
    SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT {key}, regexp_extract_all({text}, {p}) AS ms, string_split_regex({text}, {p}) AS gs FROM {table}
    ) WHERE len(ms) > 0
  )
) WHERE {keep}"""


LUHN = """
list_sum(list_transform(range(1, length(d) + 1), lambda k:
  CASE WHEN k % 2 = 0 THEN CASE WHEN CAST(substr(reverse(d), k, 1) AS INT) * 2 > 9 THEN CAST(substr(reverse(d), k, 1) AS INT) * 2 - 9
  ELSE CAST(substr(reverse(d), k, 1) AS INT) * 2 END ELSE CAST(substr(reverse(d), k, 1) AS INT) END)) % 10 = 0"""

EMAIL = r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b"
EMAIL_OK = r"regexp_matches(value, '\.[A-Za-z]{2,24}$') AND NOT contains(value, '..')"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV4_OK = r"regexp_full_match(value, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
CARD_OK = (
    "list_contains([true], (SELECT regexp_matches(d, '^(4|5[1-5]|3[47]|6011|65|30[0-5]|36|38|35)') AND " + LUHN + " FROM (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS d)))"
)
URL = r"""\bhttps?://[^\s<>"')\]]+"""


def typed_sql(table: str, key: str, text: str) -> str:
    """The four types whose rules have an SQL form, as key, start, end, entity_type, value."""
    parts = (("EMAIL", EMAIL, EMAIL_OK), ("IP_ADDRESS", IPV4, IPV4_OK), ("CREDIT_CARD", CARD, CARD_OK), ("URL", URL, "true"))
    return " UNION ALL ".join(f"""SELECT {key}, "start", "end", '{t}' AS entity_type, value FROM ({spans_sql(table, key, text, p, ok)})""" for t, p, ok in parts)


def numbered_sql(table: str, key: str, text: str) -> str:
    """The same with placeholders."""
    return f"""
WITH s AS ({typed_sql(table, key, text)}),
f AS (SELECT *, min("start") OVER (PARTITION BY {key}, entity_type, lower(value)) AS first FROM s)
SELECT {key}, "start", "end", entity_type, value,
  '[' || entity_type || '_' || dense_rank() OVER (PARTITION BY {key}, entity_type ORDER BY first) || ']' AS placeholder FROM f"""


def rows_sql(rows, columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS t({columns})"
