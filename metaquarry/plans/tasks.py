"""Registered slot-filling queries over events: a user is a thread, an event sets a slot."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaquarry.operators import slots as sl
from metaquarry.plans import sqlparts as sp
from metaquarry.plans.registry import query
from metaquarry.schemas import TEMPLATES

# Three task templates: what they need, how slots are typed, where they go in the payload.
RULES = [
    {
        "template_code": "site_survey",
        "required": ["site", "surveyor"],
        "types": {"depth": "integer", "site": "string"},
        "enums": {},
        "render": {
            "visit.place.site": "$site",
            "visit.place.mark": "$mark",
            "visit.by": "$surveyor",
            "depth": "$depth",
        },
        "defaults": {"kind": "SURVEY", "depth": "5", "visit.place.grid": "0042"},
        "keys": {"kind": "string", "visit": "object", "depth": "integer", "season": "string"},
        "keys_required": ["kind", "visit", "season"],
        "sources": ["RIVER", "LAKE"],
        "targets": ["MAP"],
        "incremental": False,
        "needs": {},
    },
    {
        "template_code": "exhibit_loan",
        "required": ["site", "crate", "insurer"],
        "types": {"depth": "integer", "mark": "number"},
        "enums": {},
        "render": {
            "loan.item": "$site",
            "loan.terms.crate": "$crate",
            "loan.terms.cover.depth": "$depth",
            "loan.terms.cover.mark": "$mark",
        },
        "defaults": {"kind": "LOAN", "days": "30"},
        "keys": {"kind": "string", "loan": "object", "days": "integer", "cover": "object"},
        "keys_required": ["kind", "loan", "cover"],
        "sources": ["MUSEUM", "LAKE", "ARCHIVE"],
        "targets": ["LEDGER", "MAP"],
        "incremental": True,
        "needs": {},
    },
    {
        "template_code": "digest",
        "required": ["surveyor", "target_type"],
        "types": {"depth": "string"},
        "enums": {"target_type": ["PRINT", "MAIL"]},
        "render": {
            "to": "$surveyor",
            "medium": "$target_type",
            "sheet": "$mark",
            "notes.depth": "$depth",
        },
        "defaults": {"kind": "DIGEST", "medium": "PRINT"},
        "keys": {"kind": "string", "to": "string", "medium": "string", "sheet": "integer", "notes": "array"},
        "keys_required": ["kind", "to", "medium"],
        "sources": ["ARCHIVE"],
        "targets": ["PRINT", "MAIL"],
        "incremental": False,
        "needs": {"PRINT": ["mark"], "MAIL": ["depth"]},
    },
]


def templates(spark):
    """The three templates as catalog rows (only the rule columns are filled)."""
    rows = []
    for no, r in enumerate(RULES):
        slots = {s: {"type": r["types"].get(s, "string"), "enum": r["enums"].get(s)}
                 for s in {**r["types"], **r["enums"]}}
        rows.append(
            {
                "doc_id": str(no),
                "template_code": r["template_code"],
                "required_slots": r["required"],
                "slot_schema": slots,
                "render_rules": r["render"],
                "default_payload": r["defaults"],
                "payload_schema": {
                    "required": r["keys_required"],
                    "properties": {k: {"type": v} for k, v in r["keys"].items()},
                },
                "compatibility_rules": {
                    "source_types": r["sources"],
                    "target_types": r["targets"],
                    "supports_incremental": r["incremental"],
                    "target_type_requires": r["needs"],
                },
            }
        )
    wanted = ["doc_id", "template_code", "required_slots", "slot_schema", "render_rules",
              "default_payload", "payload_schema", "compatibility_rules"]
    schema = TEMPLATES.schema
    return spark.createDataFrame(rows, type(schema)([schema[n] for n in wanted]))


SLOT_OF = {
    "signup": "site",
    "view": "surveyor",
    "click": "crate",
    "purchase": "mark",
    "error": "depth",
}


def slot_log(t):
    """thread_id, template_no, slot, value, ts, event_id. Digest threads set a target type
    where others set a crate."""
    no = F.pmod("user_id", F.lit(3))
    slot = F.col("event_type")
    for event, name in SLOT_OF.items():
        slot = F.when(F.col("event_type") == event, name).otherwise(slot)
    whole = F.col("value").cast("long")
    target = (
        F.when(whole % 3 == 0, "PRINT").when(whole % 3 == 1, "MAIL").otherwise("SHEET")
    )
    is_target = (no == 2) & (F.col("event_type") == "click")
    value = (
        F.when(is_target, target)
        .when(F.col("event_type") == "purchase", whole.cast("string"))
        .when((F.col("event_type") == "error") & (whole % 2 == 0), whole.cast("string"))
        .otherwise(F.concat(F.lit("v"), whole.cast("string")))
    )
    return t.events.select(
        F.col("user_id").alias("thread_id"),
        no.alias("template_no"),
        F.when(is_target, "target_type").otherwise(slot).alias("slot"),
        value.alias("value"),
        "ts",
        "event_id",
    )


def collected(t):
    latest = sl.latest_params(slot_log(t), "thread_id", "slot", "value", ["ts", "event_id"])
    code = F.element_at(
        F.array(*[F.lit(r["template_code"]) for r in RULES]), (F.pmod("thread_id", F.lit(3)) + 1).cast("int")
    )
    # three templates: always small
    return latest.withColumn("template_code", code).join(F.broadcast(templates(t.spark)), "template_code")


def entries(m):
    """A map as sorted key=value text."""
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


LOG = """
slot_log AS (
  SELECT user_id AS thread_id, user_id % 3 AS template_no,
    CASE WHEN user_id % 3 = 2 AND event_type = 'click' THEN 'target_type' ELSE CASE event_type
      WHEN 'signup' THEN 'site' WHEN 'view' THEN 'surveyor' WHEN 'click' THEN 'crate'
      WHEN 'purchase' THEN 'mark' ELSE 'depth' END END AS slot,
    CASE WHEN user_id % 3 = 2 AND event_type = 'click'
        THEN CASE trunc(value)::BIGINT % 3 WHEN 0 THEN 'PRINT' WHEN 1 THEN 'MAIL' ELSE 'SHEET' END
      WHEN event_type = 'purchase' OR (event_type = 'error' AND trunc(value)::BIGINT % 2 = 0)
        THEN (trunc(value)::BIGINT)::VARCHAR
      ELSE 'v' || trunc(value)::BIGINT END AS value, ts, event_id FROM events),
latest AS (SELECT thread_id, template_no, slot, value FROM (SELECT *, row_number() OVER
  (PARTITION BY thread_id, slot ORDER BY ts DESC, event_id DESC) AS n FROM slot_log) WHERE n = 1),
threads AS (SELECT DISTINCT thread_id, template_no FROM latest)"""


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(sp.quote(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {values})"


REQUIRED = _rows(
    "required", "template_no, ord, slot",
    [(n, i, s) for n, r in enumerate(RULES) for i, s in enumerate(r["required"])],
)
NEEDS = _rows(
    "needs", "template_no, target_type, slot",
    [(n, k, s) for n, r in enumerate(RULES) for k, v in r["needs"].items() for s in v],
)
RENDER = _rows(
    "render", "template_no, path, slot",
    [(n, p, s[1:]) for n, r in enumerate(RULES) for p, s in r["render"].items()],
)
DEFAULTS = _rows(
    "defaults", "template_no, path, value",
    [(n, p, v) for n, r in enumerate(RULES) for p, v in r["defaults"].items()],
)
KEYS = _rows(
    "keys", "template_no, top, kind, needed",
    [(n, k, v, k in r["keys_required"]) for n, r in enumerate(RULES) for k, v in r["keys"].items()],
)
TYPES = _rows(
    "types", "template_no, path, kind",
    [(n, p, r["types"][s[1:]]) for n, r in enumerate(RULES) for p, s in r["render"].items() if s[1:] in r["types"]],
)
MISSING = """
missing AS (
  SELECT thread_id, ord, slot FROM threads JOIN required USING (template_no)
    WHERE (thread_id, slot) NOT IN (SELECT (thread_id, slot) FROM latest)
  UNION ALL SELECT n.thread_id, 100, needs.slot FROM latest n JOIN needs ON n.template_no = needs.template_no
    AND n.slot = 'target_type' AND n.value = needs.target_type
    WHERE (n.thread_id, needs.slot) NOT IN (SELECT (thread_id, slot) FROM latest)),
missing_list AS (SELECT thread_id, coalesce(string_agg(slot, ',' ORDER BY ord) FILTER (slot IS NOT NULL), '') AS missing
  FROM threads LEFT JOIN missing USING (thread_id) GROUP BY 1)"""
FLAT = """
filled AS (SELECT thread_id, path, value FROM latest JOIN render USING (template_no, slot)),
flat AS (SELECT * FROM filled UNION ALL SELECT thread_id, path, value FROM threads JOIN defaults USING (template_no)
  WHERE (thread_id, path) NOT IN (SELECT (thread_id, path) FROM filled)),
typed AS (SELECT f.thread_id, f.path, f.value, coalesce(types.kind, keys.kind, 'string') AS kind
  FROM flat AS f JOIN threads USING (thread_id) LEFT JOIN types USING (template_no, path)
  LEFT JOIN keys ON keys.template_no = threads.template_no AND keys.top = path),
cells AS (SELECT thread_id, path, CASE WHEN kind IN ('integer', 'number') AND regexp_matches(value, '^(0|[1-9][0-9]*)$')
    THEN value ELSE '"' || value || '"' END AS v FROM typed),
tops AS (SELECT thread_id, split_part(path, '.', 1) AS top, max(CASE WHEN path LIKE '%.%' THEN 'object'
  WHEN v LIKE '"%' THEN 'string' ELSE 'integer' END) AS kind FROM cells GROUP BY 1, 2)"""


@query(
    "i1_select_template",
    sp.with_(
        LOG,
        REQUIRED,
        NEEDS,
        MISSING,
        select="""SELECT thread_id, missing <> '' AS resumed,
          CASE WHEN missing <> '' THEN 'stored' ELSE 'best' END AS template_code FROM missing_list""",
    ),
)
def i1(t):
    state = _missing(t).select("thread_id", F.lit("stored").alias("template_code"), sl.task_status(F.col("missing")).alias("status"))
    hits = t.events.select(F.col("user_id").alias("thread_id")).distinct()
    hits = hits.select("thread_id", F.lit(1).alias("rk"), F.lit("best").alias("template_code"))
    return sl.select_template(hits, state)


@query(
    "i2_merge_params",
    sp.with_(
        LOG,
        select="""SELECT thread_id, string_agg(slot || '=' || value, ';' ORDER BY slot) AS params FROM latest GROUP BY 1""",
    ),
)
def i2(t):
    """The log cut at an arbitrary event into old and new, merged per thread."""
    log = slot_log(t)
    late = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    order = ["ts", "event_id"]
    old = sl.latest_params(log.where(~late), "thread_id", "slot", "value", order)
    new = sl.latest_params(log.where(late), "thread_id", "slot", "value", order)
    both = old.withColumnRenamed("collected", "_old").join(new, "thread_id", "full_outer")
    return both.select("thread_id", entries(sl.merge_params(F.col("_old"), F.col("collected"))).alias("params"))


def _missing(t):
    return collected(t).withColumn(
        "missing",
        sl.missing_params(F.col("required_slots"), F.col("collected"), F.col("compatibility_rules")),
    )


@query(
    "i3_task_status",
    sp.with_(
        LOG,
        REQUIRED,
        NEEDS,
        MISSING,
        select="""SELECT CASE WHEN missing = '' THEN 'ready' ELSE 'collecting' END AS status, count(*) AS n
          FROM missing_list GROUP BY 1""",
    ),
)
def i3(t):
    return _missing(t).groupBy(sl.task_status(F.col("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "i4_missing_params",
    sp.with_(LOG, REQUIRED, NEEDS, MISSING, select="SELECT thread_id, missing FROM missing_list"),
)
def i4(t):
    return _missing(t).select("thread_id", F.array_join("missing", ",").alias("missing"))


@query(
    "i5_render_payload",
    sp.with_(LOG, RENDER, DEFAULTS, KEYS, TYPES, FLAT, select="SELECT thread_id, path, value FROM flat"),
)
def i5(t):
    flat = sl.payload_values(F.col("render_rules"), F.col("default_payload"), F.col("collected"))
    return collected(t).select("thread_id", F.explode(flat).alias("path", "value"))


@query(
    "i5_render_payload_json",
    sp.with_(
        LOG,
        RENDER,
        DEFAULTS,
        KEYS,
        TYPES,
        FLAT,
        # objects of up to four levels, from the innermost
        """l4 AS (SELECT thread_id, string_split(path, '.') AS p, v FROM cells),
        l3 AS (SELECT thread_id, p, v FROM l4 WHERE len(p) < 4 UNION ALL
          SELECT thread_id, p[:3], '{' || string_agg('"' || p[4] || '":' || v, ',' ORDER BY p[4]) || '}'
          FROM l4 WHERE len(p) = 4 GROUP BY 1, 2),
        l2 AS (SELECT thread_id, p, v FROM l3 WHERE len(p) < 3 UNION ALL
          SELECT thread_id, p[:2], '{' || string_agg('"' || p[3] || '":' || v, ',' ORDER BY p[3]) || '}'
          FROM l3 WHERE len(p) = 3 GROUP BY 1, 2),
        l1 AS (SELECT thread_id, p, v FROM l2 WHERE len(p) < 2 UNION ALL
          SELECT thread_id, p[:1], '{' || string_agg('"' || p[2] || '":' || v, ',' ORDER BY p[2]) || '}'
          FROM l2 WHERE len(p) = 2 GROUP BY 1, 2)""",
        select="""SELECT thread_id, '{' || string_agg('"' || p[1] || '":' || v, ',' ORDER BY p[1]) || '}' AS payload
          FROM l1 GROUP BY 1""",
    ),
)
def i5_json(t):
    return collected(t).select("thread_id", payload().alias("payload"))


def payload(indent=None):
    rules = ["render_rules", "default_payload", "collected", "slot_schema", "payload_schema"]
    return sl.render_payload(*map(F.col, rules), indent)


@query(
    "i6_validate_payload",
    sp.with_(
        LOG,
        RENDER,
        DEFAULTS,
        KEYS,
        TYPES,
        FLAT,
        select="""SELECT thread_id, 'missing:' || top AS error FROM threads JOIN keys USING (template_no)
            WHERE needed AND (thread_id, top) NOT IN (SELECT (thread_id, top) FROM tops)
          UNION ALL SELECT thread_id, 'type:' || top FROM threads JOIN keys USING (template_no)
            JOIN tops USING (thread_id, top) WHERE tops.kind <> keys.kind""",
    ),
)
def i6(t):
    errors = sl.payload_errors(F.col("payload"), F.col("payload_schema"))
    rows = collected(t).withColumn("payload", payload())
    return rows.select("thread_id", F.explode(errors).alias("error"))


@query(
    "i7_validate_slots",
    sp.with_(
        LOG,
        select="""SELECT thread_id, 'type:' || slot AS error FROM latest WHERE slot = 'depth'
            AND template_no IN (0, 1) AND NOT regexp_matches(value, '^[0-9]+$')
          UNION ALL SELECT thread_id, 'enum:' || slot FROM latest WHERE slot = 'target_type' AND template_no = 2
            AND value NOT IN ('PRINT', 'MAIL')""",
    ),
)
def i7(t):
    errors = sl.slot_errors(F.col("collected"), F.col("slot_schema"))
    return collected(t).select("thread_id", F.explode(errors).alias("error"))


KINDS_FROM, KINDS_TO = ["RIVER", "LAKE", "MUSEUM", "ARCHIVE"], ["MAP", "LEDGER", "PRINT", "MAIL", "FILM"]
MODES = ["FULL", "INCREMENTAL"]
PAIRS = _rows(
    "pairs", "template_code, source_type, target_type, incremental",
    [(r["template_code"], s, d, r["incremental"]) for r in RULES for s in r["sources"] for d in r["targets"]],
)


@query(
    "i8_compatible_templates",
    sp.with_(
        PAIRS,
        f"""requests AS (SELECT o_orderkey AS request_id, {sp.pick(KINDS_FROM, "o_orderkey")} AS source_type,
          {sp.pick(KINDS_TO, "o_custkey")} AS target_type, {sp.pick(MODES, "o_orderkey + o_custkey")} AS mode FROM orders)""",
        select="""SELECT request_id, template_code, source_type, target_type, mode FROM requests
          JOIN pairs USING (source_type, target_type) WHERE mode <> 'INCREMENTAL' OR incremental""",
    ),
)
def i8(t):
    from metaquarry.sources.metadata import _pick

    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        _pick(KINDS_FROM, F.col("o_orderkey")).alias("source_type"),
        _pick(KINDS_TO, F.col("o_custkey")).alias("target_type"),
        _pick(MODES, F.col("o_orderkey") + F.col("o_custkey")).alias("mode"),
    )
    rules = templates(t.spark).withColumns(
        {"source_types": F.array().cast("array<string>"), "target_types": F.array().cast("array<string>")}
    )
    return sl.compatible_templates(requests, rules)


@query(
    "i9_task_message",
    sp.with_(
        LOG,
        REQUIRED,
        NEEDS,
        MISSING,
        RENDER,
        DEFAULTS,
        KEYS,
        TYPES,
        FLAT,
        # ready threads are of the survey or the digest: objects of up to three levels
        """p3 AS (SELECT thread_id, string_split(path, '.') AS p, v FROM cells),
        p2 AS (SELECT thread_id, p, v FROM p3 WHERE len(p) < 3 UNION ALL
          SELECT thread_id, p[:2], '{' || chr(10) || string_agg('      "' || p[3] || '": ' || v, ',' || chr(10) ORDER BY p[3])
            || chr(10) || '    }' FROM p3 WHERE len(p) = 3 GROUP BY 1, 2),
        p1 AS (SELECT thread_id, p, v FROM p2 WHERE len(p) < 2 UNION ALL
          SELECT thread_id, p[:1], '{' || chr(10) || string_agg('    "' || p[2] || '": ' || v, ',' || chr(10) ORDER BY p[2])
            || chr(10) || '  }' FROM p2 WHERE len(p) = 2 GROUP BY 1, 2),
        shown AS (SELECT thread_id, '{' || chr(10) || string_agg('  "' || p[1] || '": ' || v, ',' || chr(10) ORDER BY p[1])
            || chr(10) || '}' AS task FROM p1 GROUP BY 1)""",
        select=f"""SELECT thread_id, CASE WHEN missing <> '' THEN {sp.quote(sl.NEED_OPEN)} || replace(missing, ',', ', ')
            || {sp.quote(sl.NEED_CLOSE)} || 'why'
          ELSE {sp.quote(sl.DONE_OPEN)} || task || {sp.quote(sl.DONE_CLOSE)} || 'why' END AS message
          FROM missing_list JOIN shown USING (thread_id)""",
    ),
)
def i9(t):
    message = sl.task_message(F.col("missing"), payload(indent=2), F.lit("why"))
    return _missing(t).select("thread_id", message.alias("message"))
