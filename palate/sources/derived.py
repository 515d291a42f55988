"""The model's tables, derived from the raw ones.

Each definition is one SQL text that an ANSI engine reads; ``{name}`` stands for another table, and ``as_ctes``
writes the definitions out. In Spark every name becomes a DataFrame: that of ``BUILT`` where the DataFrame API says
it better (so the two engines check two formulations), else the same text. Those in ``STORED``, which many queries
need, are written to the shared folder once for each application and data folder.

thumbs    user_id, item_id, tag ('' is the thing itself), value +1 or -1
follows   follower_id, followed_id: the next twenty customers of one's nation, in a ring
still     the follows that are left after a clearing out of most accounts
profiles  id, display_name, nation, prefilled, handle
items     id, search_id
said      what the accounts a viewer follows say: viewer, item_id, tag, n, s, m (the smoothed mean)
log       one row per event: event_id, user_id, item_id, tag, value (0 clears), ts
removed   names taken out of the catalog
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import opinions
from . import store

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DEFINITIONS: dict[str, str] = {
    "bought": """
        SELECT concat('c', cast(o.o_custkey AS {str})) AS user_id, o.o_custkey AS cust,
               concat(p.p_name, ' ', lower(p.p_type)) AS item_id, lower(p.p_brand) AS brand, p.p_name AS p_name,
               lower(p.p_type) AS kind,
               CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS flag,
               5 - cast(round(l.l_discount * 100) AS int) AS cut
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
    """,
    "thumbs": """
        SELECT user_id, item_id, tag, CASE WHEN s > 0 THEN 1 ELSE -1 END AS value FROM (
            SELECT user_id, item_id, '' AS tag, sum(flag) AS s FROM {bought} GROUP BY user_id, item_id
            UNION ALL
            SELECT user_id, item_id, tag, sum(cut) AS s FROM (
                SELECT user_id, item_id, cust, brand AS tag, cut FROM {bought}
                UNION ALL SELECT user_id, item_id, cust, split_part(p_name, ' ', 1) AS tag, cut FROM {bought}
                UNION ALL SELECT user_id, item_id, cust, split_part(p_name, ' ', 2) AS tag, cut FROM {bought}
                UNION ALL SELECT user_id, item_id, cust, kind AS tag, cut FROM {bought}
            ) tagged WHERE (cust + length(item_id)) % 3 = 0 GROUP BY user_id, item_id, tag
        ) sums WHERE s <> 0
    """,
    "ring": """
        SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place,
               count(*) OVER (PARTITION BY c_nationkey) AS size
        FROM {customer}
    """,
    "steps": "SELECT 1 + a.r_regionkey + 5 * b.r_regionkey AS step FROM {region} a CROSS JOIN {region} b WHERE b.r_regionkey < 4",
    "follows": """
        SELECT concat('c', cast(a.c_custkey AS {str})) AS follower_id, concat('c', cast(b.c_custkey AS {str})) AS followed_id
        FROM (SELECT r.c_custkey, r.c_nationkey, (r.place + s.step) % r.size AS target
              FROM {ring} r JOIN {steps} s ON s.step < r.size) a
        JOIN {ring} b ON a.c_nationkey = b.c_nationkey AND a.target = b.place
    """,
    "still": """
        SELECT f.follower_id, f.followed_id FROM {follows} f JOIN {profiles} q ON q.id = f.followed_id
        WHERE q.prefilled OR (q.nation + length(q.id) + cast(substr(f.followed_id, 2) AS int)) % 10 = 0
    """,
    "profiles": """
        SELECT concat('c', cast(c_custkey AS {str})) AS id, c_name AS display_name, c_nationkey AS nation,
               c_custkey % 50 = 0 AS prefilled,
               CASE WHEN c_custkey % 50 = 0 THEN concat('h', cast(c_custkey AS {str})) END AS handle
        FROM {customer}
    """,
    "items": "SELECT DISTINCT concat(p_name, ' ', lower(p_type)) AS id, concat(p_name, ' ', lower(p_type)) AS search_id FROM {part}",
    "heard": """
        SELECT f.follower_id AS viewer, t.user_id AS who, t.item_id, t.tag, t.value
        FROM {follows} f JOIN {thumbs} t ON f.followed_id = t.user_id
    """,
    "said": """
        SELECT viewer, item_id, tag, n, s, cast(s AS double) / (n + 2) AS m FROM (
            SELECT viewer, item_id, tag, count(value) AS n, cast(coalesce(sum(value), 0) AS bigint) AS s FROM (
                SELECT viewer, item_id, tag, value FROM {heard}
                UNION ALL
                SELECT DISTINCT viewer, item_id, '' AS tag, cast(NULL AS int) AS value FROM {heard}
            ) rows_ GROUP BY viewer, item_id, tag
        ) counted
    """,
    "scores": """
        SELECT viewer, item_id, tag, n AS conf, greatest(least(m, 1 - 1e-9), -1 + 1e-9) AS score,
               CASE WHEN tag = '' THEN cast(1.0 AS double)
                    ELSE (1 + greatest(least(m, 1 - 1e-9), -1 + 1e-9)) / 2 END AS applies
        FROM {said}
    """,
    "everyone": """
        SELECT item_id, tag, n, cast(s AS double) / (n + 2) AS m FROM (
            SELECT item_id, tag, count(value) AS n, cast(coalesce(sum(value), 0) AS bigint) AS s FROM (
                SELECT item_id, tag, value FROM {thumbs}
                UNION ALL SELECT DISTINCT item_id, '' AS tag, cast(NULL AS int) AS value FROM {thumbs}
            ) r GROUP BY item_id, tag
        ) c
    """,
    "log": """
        SELECT event_id, concat('u', cast(user_id AS {str})) AS user_id,
               concat('k', regexp_extract(props, '([0-9]+)', 1)) AS item_id,
               CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS tag,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 0 ELSE -1 END AS value,
               ts
        FROM {events}
    """,
    "held": """
        SELECT user_id, item_id, tag, value, event_id FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, item_id, tag ORDER BY event_id DESC) AS back FROM {log}
        ) l WHERE back = 1 AND value <> 0
    """,
    "changes": """
        SELECT event_id, user_id, item_id, tag, value, ts,
               CASE WHEN value <> coalesce(lag(value) OVER (PARTITION BY user_id, item_id, tag ORDER BY event_id), 0)
                    THEN 1 ELSE 0 END AS changed
        FROM {log}
    """,
    "revisions": """
        SELECT event_id, user_id, item_id, tag, value, ts, changed,
               cast(sum(changed) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS revision
        FROM {changes}
    """,
    "removed": "SELECT id FROM {items} WHERE length(id) % 7 = 0",
    "points": """
        SELECT vec_id, label, cast(embedding[{first}] AS double) AS x, cast(embedding[{second}] AS double) AS y,
               cast(embedding[{third}] AS double) AS z
        FROM {embeddings}
    """,
}

_SPARK = {"str": "string", "first": "0", "second": "1", "third": "2"}
_ANSI = {"str": "varchar", "first": "1", "second": "2", "third": "3"}


#: Spark's own way to some of the tables.
BUILT: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    "thumbs": lambda t: opinions.thumbs(t("lineitem"), t("orders"), t("part")),
    "said": lambda t: opinions.said(t("thumbs"), t("follows")),
    "everyone": lambda t: opinions.everyone(t("thumbs")),
    "held": lambda t: opinions.held(t("log")),
}
STORED = {"thumbs", "follows"}
_stored: dict[tuple[str, str, str], DataFrame] = {}


def needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in DEFINITIONS or n in RAW]


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The SQL ``text`` over raw and derived tables of ``sf_dir``."""
    return _Tables(spark, sf_dir).sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _Tables(spark, sf_dir).get(name)


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def get(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self._stored(name) if name in STORED else self._made(name)
        return self.made[name]

    def _made(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return BUILT[name](self.get) if name in BUILT else self.sql(DEFINITIONS[name])

    def _stored(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = store.save(self._made(name), name)
        return _stored[key]

    def sql(self, text: str) -> DataFrame:
        names = needs(text)
        for k, v in _SPARK.items():
            text = text.replace("{" + k + "}", v)
        return self.spark.sql(text, **{n: self.get(n) for n in names})


def as_ctes(text: str) -> str:
    """The same query, self-contained, for an ANSI engine that has the raw tables."""
    order: list[str] = []

    def visit(t: str) -> None:
        for n in needs(t):
            if n in DEFINITIONS and n not in order:
                visit(DEFINITIONS[n])
                order.append(n)

    visit(text)

    def plain(t: str) -> str:
        for k, v in _ANSI.items():
            t = t.replace("{" + k + "}", v)
        return re.sub(r"\{(\w+)\}", r"\1", t)

    if not order:
        return plain(text)
    return "WITH " + ", ".join(f"{n} AS ({plain(DEFINITIONS[n])})" for n in order) + f" SELECT * FROM ({plain(text)}) q"
