"""Engine tables built from the driver's tables, as SQL that Spark and DuckDB both
read, so that an oracle checks the operator and not the adapter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sut(k: str) -> str:
    return (
        f"'com.acme.p' || CAST({k} % 13 AS STRING) || '.C' || CAST({k} AS STRING) || CASE {k} % 6 WHEN 0 THEN 'Service' "
        f"WHEN 1 THEN 'Repository' WHEN 2 THEN 'Dto' WHEN 3 THEN 'Test' WHEN 4 THEN 'Mapper' ELSE '' END"
    )


SECONDS = "CAST(day(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"

ADAPTERS: dict[str, str] = {
    "targets": f"""
        SELECT 'r' || CAST(l_orderkey % 8 AS STRING) AS repo,
               'tgt:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS target_id, {sut("l_orderkey")} AS sut,
               CASE WHEN l_linenumber = 4 THEN 'lambda$m3$0()V' ELSE 'm' || CAST(l_linenumber AS STRING) || '()V' END AS method,
               l_linenumber AS pos, CAST(SUM(CAST(floor(l_quantity) AS BIGINT) % 6) AS BIGINT) AS missed_lines,
               CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT) % 3) AS BIGINT) AS missed_branches
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "coverage": f"""
        SELECT 'r' || CAST(l_orderkey % 8 AS STRING) AS repo, CASE l_linestatus WHEN 'O' THEN 'before' ELSE 'after' END AS snapshot,
               {sut("l_orderkey")} AS fqcn, CAST(SUM(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS covered_lines,
               CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT) % 50) AS BIGINT) AS covered_branches
        FROM lineitem GROUP BY l_orderkey, l_linestatus""",
    "classes": f"""
        SELECT 'r' || CAST(o_orderkey % 8 AS STRING) AS repo, {sut("o_orderkey")} AS fqcn,
               CASE WHEN o_orderkey % 10 = 0 THEN 'interface' WHEN o_orderkey % 10 = 1 THEN 'enum' WHEN o_orderkey % 10 = 2 THEN 'record' ELSE 'class' END AS kind,
               CASE o_orderkey % 9 WHEN 0 THEN 'RestController' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN 'Configuration'
                    WHEN 4 THEN 'Mapper' WHEN 5 THEN 'Component' ELSE NULL END AS annotation,
               o_orderkey % 14 = 0 AS is_abstract, o_orderkey AS class_no
        FROM orders""",
    "classification": f"""
        SELECT {sut("o_orderkey")} AS fqcn,
               CASE WHEN o_orderkey % 11 = 0 THEN 'generated' WHEN o_orderkey % 11 = 1 THEN 'generated/excluded' WHEN o_orderkey % 11 < 5 THEN 'service'
                    WHEN o_orderkey % 11 < 8 THEN 'controller' ELSE 'component' END AS type,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' WHEN '4' THEN 'odd' ELSE NULL END AS testability_risk,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'templates/t' || CAST(o_orderkey % 4 AS STRING) || '.java' END AS template
        FROM orders WHERE o_orderkey % 7 <> 0""",
    "failure_memory": f"""
        SELECT event_id, {sut("(1 + event_id % 4000)")} || '#m' || CAST(event_id % 5 AS STRING) AS symbol_fqn, 'E_' || CAST(user_id % 9 AS STRING) AS error_code,
               'FIX_' || CAST(user_id % 4 AS STRING) AS fix_id, 1 + event_id % 4 AS attempts, CASE event_id % 3 WHEN 0 THEN 'SUCCESS' ELSE 'FAILED' END AS last_result,
               CAST(day(ts) AS BIGINT) AS last_seen_cycle, 'tc' || CAST(user_id % 400 AS STRING) AS test_case_id
        FROM events WHERE event_type IN ('error', 'click')""",
    "affected": f"SELECT {sut('o_orderkey')} AS fqcn FROM orders WHERE o_orderkey % 5 = 0",
    "fixtures": f"""
        SELECT {sut("o_orderkey")} AS fqcn, 'fx:' || CAST(o_orderkey AS STRING) AS fixture_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'builder' WHEN 1 THEN 'constructor' WHEN 2 THEN 'mock' ELSE 'static-factory' END AS strategy
        FROM orders WHERE o_orderkey % 3 = 0""",
    "generated_rules": """
        SELECT 'package' AS rule_kind, 'com.acme.p' || CAST(n_nationkey AS STRING) AS pattern FROM nation WHERE n_nationkey IN (2, 12)
        UNION ALL SELECT 'fqcn' AS rule_kind, 'com.acme.p' || CAST(c_custkey % 13 AS STRING) || '.C' || CAST(c_custkey AS STRING) AS pattern FROM customer""",
    "test_cases": f"""
        SELECT {sut("(o_orderkey % 3000)")} AS sut, 'tc' || CAST(o_orderkey AS STRING) AS test_case_id,
               CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIP' END AS status,
               o_orderkey % 4 AS errors, o_orderkey % 3 AS repairs, o_orderkey AS pos
        FROM orders""",
    "interactions": """
        SELECT 'run' || CAST(conv_id AS STRING) AS run_id, 't' || CAST(turn % 3 AS STRING) AS target_id,
               CASE role WHEN 'user' THEN 'generation' WHEN 'assistant' THEN 'repair' ELSE 'review' END AS role, CAST(turn AS BIGINT) AS round,
               CAST(length(coalesce(text, '')) AS BIGINT) AS tokens_in, CAST(length(coalesce(text, '')) % 97 AS BIGINT) AS tokens_out,
               CASE conv_id % 8 WHEN 0 THEN 'x/Opus-4' WHEN 1 THEN 'sonnet-3' WHEN 2 THEN 'gpt-4o-mini' WHEN 3 THEN 'GPT-4o' WHEN 4 THEN 'haiku' WHEN 5 THEN 'o3'
                    WHEN 6 THEN 'mystery' ELSE NULL END AS model, conv_id % 3 = 0 AS estimated, CAST(length(coalesce(text, '')) % 60 AS BIGINT) AS duration_ms
        FROM conversations""",
    "cycle_events": """
        SELECT 'u' || CAST(user_id AS STRING) AS run_id, CAST(day(ts) AS BIGINT) AS cycle,
               CASE WHEN SUM(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END) = 0 THEN NULL
                    ELSE CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) END AS lines_delta,
               CASE WHEN SUM(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END) = 0 THEN NULL
                    ELSE CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) END AS branches_delta,
               MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS compile_failed
        FROM events GROUP BY user_id, day(ts)""",
    "target_events": f"""
        SELECT 'run' || CAST(user_id % 50 AS STRING) AS run_id, 't' || CAST(user_id AS STRING) AS target_id, event_id AS seq, {SECONDS} AS sec,
               CASE event_type WHEN 'signup' THEN 'GENERATED' WHEN 'view' THEN 'GENERATION_REQUESTED' WHEN 'click' THEN 'TEST_FAILED'
                    WHEN 'error' THEN 'COMPILE_FAILED' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'PASSED' ELSE 'REPAIR_REQUESTED' END ELSE 'PENDING' END AS status
        FROM events""",
    "clock_events": f"""
        SELECT 'u' || CAST(user_id AS STRING) AS run_id, event_id AS seq, {SECONDS} AS sec,
               CASE event_type WHEN 'signup' THEN 'tick' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'error' THEN 'cycle' ELSE 'tick' END AS kind
        FROM events""",
    "requests": "SELECT 'b' || CAST(c_custkey % 200 AS STRING) AS batch_id, 't' || CAST(c_custkey AS STRING) AS target_id, c_custkey AS pos FROM customer",
    "responses": """
        SELECT 'b' || CAST(o_custkey % 200 AS STRING) AS batch_id, 't' || CAST(CASE WHEN o_orderkey % 40 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS STRING) AS target_id,
               o_orderkey AS pos, CASE WHEN o_orderkey % 9 = 0 THEN 'skipped' WHEN o_orderkey % 9 = 1 THEN 'NEED_MORE_CONTEXT' WHEN o_orderkey % 9 = 2 THEN 'failed'
               WHEN o_orderkey % 9 = 3 THEN 'strange' ELSE 'generated' END AS status, o_orderkey % 3 AS n_methods
        FROM orders WHERE o_orderkey % 4 < 2""",
    "dep_edges": """
        SELECT DISTINCT 'n' || CAST(l_partkey AS STRING) AS src, 'n' || CAST(l_suppkey AS STRING) AS dst,
               CASE l_linenumber % 3 WHEN 0 THEN 'injects' WHEN 1 THEN 'uses' ELSE 'extends' END AS kind
        FROM lineitem""",
    "members": f"""
        SELECT {sut("p_partkey")} AS fqcn, m AS pos, CASE m WHEN 0 THEN 'constructor' WHEN 1 THEN 'constructor' WHEN 4 THEN 'builder' ELSE 'method' END AS kind,
               CASE m WHEN 0 THEN '<init>' WHEN 1 THEN '<init>' WHEN 3 THEN '<clinit>' ELSE 'do' || CAST(m AS STRING) END AS name,
               CASE (p_size + m) % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'package' WHEN 2 THEN 'private' ELSE 'public' END AS visibility,
               CAST((p_size + 3 * m) % 5 AS BIGINT) AS n_params, (p_size + m) % 7 <> 0 AS usable,
               CASE WHEN p_size % 5 = m THEN 'java.io.IOException' WHEN p_size % 5 = m + 1 THEN 'java.lang.IllegalStateException' ELSE NULL END AS throws,
               'ev:' || CAST(p_partkey AS STRING) || ':' || CAST(m AS STRING) AS evidence_id
        FROM part CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k""",
    "dependencies": f"""
        SELECT DISTINCT {sut("(l_partkey)")} AS sut, {sut("(1 + l_suppkey)")} AS type, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem""",
    "supplied": f"""
        SELECT DISTINCT {sut("l_partkey")} AS sut, {sut("l_suppkey")} AS type, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem""",
    "imports": """
        SELECT 'p' || CAST(l_orderkey AS STRING) AS patch_id, l_linenumber AS pos,
               CASE l_partkey % 5 WHEN 0 THEN 'java.util.L' WHEN 1 THEN 'org.junit.A' WHEN 2 THEN 'com.acme.p3.C' WHEN 3 THEN 'org.mockito.M' ELSE 'odd.pkg.X' END
               || CAST(l_suppkey % 7 AS STRING) || CASE WHEN l_suppkey % 9 = 0 THEN '.*' ELSE '' END AS import
        FROM lineitem""",
    "whitelist": """
        SELECT 'class' AS level, 'java.util.L' || CAST(n_nationkey AS STRING) AS name FROM nation WHERE n_nationkey < 6
        UNION ALL SELECT 'class' AS level, 'com.acme.p3.C' || CAST(n_nationkey AS STRING) AS name FROM nation WHERE n_nationkey < 4
        UNION ALL SELECT 'package' AS level, 'org.junit' AS name FROM region WHERE r_regionkey = 0
        UNION ALL SELECT 'package' AS level, 'org.mockito' AS name FROM region WHERE r_regionkey = 1""",
    "source_files": """
        SELECT 'repo-' || coalesce(source, 'none') AS repo, doc_id,
               CASE doc_id % 9 WHEN 0 THEN 'src/main/java/com/acme/web/F' WHEN 1 THEN 'src/test/java/com/acme/F' WHEN 2 THEN 'target/classes/F' WHEN 3 THEN 'src/main/java/com/acme/service/F'
                    WHEN 4 THEN 'docs/F' WHEN 5 THEN 'src/main/java/com/acme/repository/F' WHEN 6 THEN 'src/main/resources/F' WHEN 7 THEN '.git/F' ELSE 'F' END
               || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN 'Controller.java' WHEN 1 THEN '.md' WHEN 2 THEN '.yml' WHEN 3 THEN 'Test.java' ELSE '.java' END AS path,
               CAST(length(coalesce(text, '')) AS BIGINT) AS size, coalesce(text, '') AS content
        FROM documents""",
}
_WORD = re.compile(r"\w+")


class Tables:
    """Base tables and adapters of one folder as DataFrames.  ``slim`` views are made
    only for what a query names, so each scan reads just its columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            return self.base(name)
        sql = ADAPTERS[name]
        for table in set(_WORD.findall(sql)) & set(BASE):
            self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)


def with_adapters(sql: str) -> str:
    """``sql`` for DuckDB with the adapters that it names in front."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({ADAPTERS[n]})" for n in used]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", "WITH " + body[15:]
    if ctes and body.upper().startswith("WITH "):
        return f"WITH {recursive}{', '.join(ctes)}, {body[5:]}"
    return f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else sql


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that executors share (local sessions: a temporary one)."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-gapscan-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
