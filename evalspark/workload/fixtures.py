"""Inputs derived from the given tables.

A fixture is a projection whose expressions mean the same in Spark SQL and in DuckDB, so
both sides of a comparison see identical text. ``chr(92)`` is a backslash, ``chr(10)`` a
line break.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Fixture:
    source: str
    columns: dict[str, str]
    where: str | None = None
    more: dict[str, str] | None = None  # source columns of further rows, one on top of each

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        return self.project(table(spark, sf, self.source))

    def project(self, df: DataFrame) -> DataFrame:
        if self.more:
            df = df.select(*self.more).union(df.selectExpr(*[f"{e} AS {c}" for c, e in self.more.items()]))
        kept = df.where(self.where) if self.where else df
        return kept.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"SELECT {cols} FROM {self.source_sql()}" + (f" WHERE {self.where}" if self.where else "")

    def source_sql(self) -> str:
        if not self.more:
            return self.source
        more = ", ".join(f"{e} AS {c}" for c, e in self.more.items())
        return f"(SELECT {', '.join(self.more)} FROM {self.source} UNION ALL SELECT {more} FROM {self.source})"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


TURN_KEY = {"conv_id": "conv_id", "turn": "turn"}
BOX = "concat(chr(92), 'boxed{', %s, '}')"

TEXT = Fixture("conversations", {
    **TURN_KEY,
    "reference_output": "text",
    "model_output": "CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, '.') WHEN 2 THEN lower(text) "
                    "ELSE coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 'n/a') END",
    "inference_time": "CAST((conv_id * 13 + turn) % 100 AS DOUBLE) / 10",
    "run_id": "conv_id % 7",
}, "role = 'assistant'")

BOXED = Fixture("conversations", {
    **TURN_KEY,
    "text": "text",
    "run_id": "conv_id % 7",
    "inference_time": "CAST((conv_id * 13 + turn) % 100 AS DOUBLE) / 10",
    "reference_output": f"concat(text, ' so ', {BOX % text('conv_id % 5')}, ' end')",
    "model_output": f"CASE WHEN turn % 7 = 6 THEN concat(text, ' no box') ELSE concat({BOX % text('(conv_id + turn % 2) % 5')}, ' ', text) END",
    "verdict": f"CASE WHEN conv_id % 9 = 8 THEN 'undecided' ELSE concat('because ', {BOX % text('(conv_id + turn) % 3')}) END",
    "graded": f"CASE WHEN conv_id % 4 = 3 THEN {BOX % text('turn % 3')} ELSE {BOX % ('concat(' + text('turn % 2') + ', ' + chr(39) + '.' + chr(39) + ', ' + text('conv_id % 10') + ')')} END",
})

AGENT = Fixture("conversations", {
    **TURN_KEY,
    "reference_output": f"CASE WHEN turn % 5 = 4 THEN text ELSE concat(text, chr(10), 'Final Answer: a', {text('conv_id % 3')}, chr(10), 'Action: act#', {text('turn % 2')}, chr(10), 'Value: V', {text('conv_id % 2')}) END",
    "model_output": f"CASE WHEN turn % 5 = 4 THEN concat('other ', text) ELSE concat(text, chr(10), 'answer: a', {text('(conv_id + turn) % 3')}, chr(10), 'ACTION: act#', {text('conv_id % 2')}, chr(10), 'value: x v', {text('turn % 2')}, ' y') END",
})

TOOL = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "reference_output": f"""concat('Thought: t', chr(10), 'Action: ', CASE WHEN o_orderkey % 4 = 0 THEN 'Finish' ELSE concat('tool_', {text('o_orderkey % 3')}) END, chr(10), 'Action Input: {{"k": ', {text('o_orderkey % 2')}, ', "s": "', o_orderstatus, '"}}', CASE WHEN o_orderkey % 4 = 0 THEN ' final_answer: "alpha beta gamma"' ELSE '' END)""",
    "model_output": f"""concat(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('thought: t', chr(10)) END, 'Action : ', CASE WHEN o_orderkey % 4 = 0 THEN 'Finish' ELSE concat('tool_', {text('o_custkey % 3')}) END, chr(10), CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('Action Input: {{"k": ', {text('o_custkey % 2')}, ', "s": "', o_orderstatus, '"}}') END, CASE WHEN o_orderkey % 8 = 0 THEN ' final_answer: "alpha beta"' WHEN o_orderkey % 8 = 4 THEN ' final_answer: "delta"' ELSE '' END)""",
})

JSON = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "reference_output": f"""concat('{{"status": "', o_orderstatus, '", "n": ', {text('o_orderkey % 4')}, ', "ok": true}}')""",
    "model_output": f"""CASE o_orderkey % 4 WHEN 0 THEN concat('text ```json', chr(10), '{{"status": "', lower(o_orderstatus), '", "n": "', {text('o_custkey % 4')}, '", "ok": "True"}}', chr(10), '``` tail')
    WHEN 1 THEN concat('```', chr(10), '{{"status": "X", "n": ', {text('o_orderkey % 4')}, '}}', chr(10), '```')
    WHEN 2 THEN '{{broken' ELSE '[1, 2]' END""",
})

LIST = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "reference_output": """CASE WHEN o_orderkey % 2 = 0 THEN '{"answer": "A, b ,c"}' ELSE 'a,b,c' END""",
    "model_output": """CASE o_orderkey % 5 WHEN 0 THEN '<solution> c, B, a </solution>' WHEN 1 THEN '{"answer": "a,b"}' WHEN 2 THEN 'a,a,a' WHEN 3 THEN 'a,b,z' ELSE '' END""",
})

# JSON lists and objects: equal whatever the key order, unequal in item order or number kind.
LIST_JSON = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "reference_output": """CASE WHEN o_orderkey % 4 = 3 THEN concat('["', o_orderpriority, '",', CAST(o_custkey AS STRING), ']') ELSE concat('{"a":', CAST(o_custkey AS STRING), ',"b":[1,2]}') END""",
    "model_output": """CASE o_orderkey % 4 WHEN 0 THEN concat('{"b": [1, 2], "a": ', CAST(o_custkey AS STRING), '}') WHEN 1 THEN concat('{"a":', CAST(o_custkey AS STRING), ',"b":[2,1]}')
    WHEN 2 THEN concat('{"a":', CAST(o_custkey AS STRING), '.0,"b":[1,2]}') ELSE concat('["', o_orderpriority, '", ', CAST(o_custkey AS STRING), ']') END""",
})

# A refusal object in most rows; the judge verdict text rides along.
REFUSAL = Fixture("orders", {
    "o_orderkey": "o_orderkey",
    "reference_output": "o_orderpriority",
    "model_output": """CASE o_orderkey % 5 WHEN 0 THEN concat('```json', chr(10), '{"拒识类型": "', o_orderpriority, '", "拒识话术": "no"}', chr(10), '```')
    WHEN 1 THEN concat('```json {"拒识类型": "', o_orderpriority, '"} ```') WHEN 2 THEN '```json {bad ```' WHEN 3 THEN 'plain' ELSE '```json 5 ```' END""",
    "verdict": f"CASE WHEN o_custkey % 4 = 0 THEN 'none' ELSE concat('fine ', {BOX % ('concat(' + chr(39) + '0.' + chr(39) + ', ' + text('o_custkey % 7') + ')')}) END",
})

REPORTS = Fixture("orders", {
    "id": "o_orderkey",
    "user_id": "o_custkey % 20",
    "task_id": "o_orderkey",
    "dataset": f"concat('set', {text('o_custkey % 7')}, '.jsonl')",
    "model": f"concat('org/m', {text('o_orderkey % 4')})",
    "accuracy": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END",
    "average_score": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_custkey % 16 AS DOUBLE) / 16 END",
    "total_count": "o_custkey % 50",
    "created_at": "o_orderdate",
})

RUNS = Fixture("events", {
    "id": "event_id",
    "task_id": "event_id",
    "user_id": "user_id",
    "status": "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END",
    "created_at": "ts",
})

UPDATES = Fixture("events", {
    "event_id": "event_id",
    "ts": "ts",
    "task_id": "user_id",
    "status": "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END",
    "current": "event_id % 101",
    "total": "CASE WHEN event_id % 17 = 0 THEN 0 ELSE 100 END",
    "phase": "CASE event_type WHEN 'signup' THEN 'generate' WHEN 'purchase' THEN 'score' WHEN 'error' THEN 'report' ELSE 'other' END",
    "message": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END",
})

def json_text(expr: str) -> str:
    """A JSON string literal of a text; ends of line, tabs, quotes and backslashes are escaped."""
    for char, name in (("92", "92"), ("34", "34"), ("10", "110"), ("13", "114"), ("9", "116")):
        expr = f"replace({expr}, chr({char}), concat(chr(92), chr({name})))"
    return f"concat(chr(34), {expr}, chr(34))"


DATASETS = Fixture("documents", {
    "id": "doc_id",
    "user_id": "doc_id % 9",
    "filename": f"concat(source, {text('doc_id')}, '.jsonl')",
    "description": "lang",
    "file_content": f"""concat('{{"meta": {{"meta_description": "', lang, '"}}, "turns": [{{"role": "Human", "text": "q', {text('doc_id')}, '"}}, {{"role": "Assistant", "text": ', {json_text('text')}, '}}]}}', chr(10), '  ', chr(10), CASE WHEN doc_id % 5 = 0 THEN '{{bad' WHEN doc_id % 5 = 1 THEN '{{"a": 1}} x' ELSE '{{"turns": []}}' END, chr(10), '{{"turns": [{{"role": "Assistant", "text": ', {json_text('text')}, '}}]}}', CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END)""",
    "created_at": f"concat('2024-01-', lpad({text('doc_id % 28 + 1')}, 2, '0'), 'T00:00:00Z')",
})
