"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qanat.functions.session import spread
from qanat.llm import crossdup, langid, leaks, lookalike, mixing, neardup, packing, spans, splits, textcore, tokens
from qanat.plans.registry import words_sql

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[..., DataFrame], *tables: str) -> Query:
    """Small inputs are spread over the cores; large ones come in more parts than there are."""
    return lambda spark, sf_dir: f(*(spread(t) if i == 0 else t for i, t in enumerate(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables)))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(splits.parted, "release_rows"),
        "p1_splits": _on(splits.split_rows, "release_rows", "split_targets"),
        "p1_shares": _on(splits.split_shares, "release_rows", "split_targets"),
        "p2_found": _on(lambda rows: spans.shared_messages(rows).select("row_id", "turn"), "release_rows"),
        "p2_shares": _on(spans.shared_shares, "release_rows"),
        "p3_found": _on(lambda rows: crossdup.cross_pairs(rows).select("row_id_a", "row_id_b"), "release_rows"),
        "p3_counts": _on(crossdup.cross_counts, "release_rows"),
        "p4_found": _on(lookalike.alike_pairs, "release_rows"),
        "p4_forms": _on(lookalike.consistent_messages, "release_rows"),
        "p5_found": _on(neardup.near_pairs, "release_rows"),
        "p5_groups": _on(neardup.near_groups, "release_rows"),
        "p6_row_tokens": _on(tokens.row_tokens, "release_rows"),
        "p6_token_totals": _on(tokens.token_totals, "release_rows"),
        "p7_found": _on(lambda rows, scenarios: leaks.leaks(rows, scenarios).select("row_id", "scenario_id", "turn", "field").distinct(), "release_rows", "scenarios"),
        "p8_containers": _on(packing.containers, "documents", "pack_limits"),
        "p9_draw": _on(lambda d, t: mixing.mixture(d, t)[0], "documents", "mix_targets"),
        "p9_shares": _on(lambda d, t: mixing.mixture(d, t)[1], "documents", "mix_targets"),
        "p10_found": _on(langid.wrong_lines, "documents", "lang_samples"),
        "p10_documents": _on(langid.document_languages, "documents", "lang_samples"),
        "p10_lines": _on(langid.line_languages, "documents", "lang_samples"),
    }


def _form(column: str) -> str:
    """The consistent form with its table of several-character forms spelled out."""
    several = ", ".join(f"'{c}': '{to}'" for c, to in textcore._tables()[1].items())
    return textcore.form_sql(column).replace("getvariable('several')", f"(MAP {{{several}}})")


def _shares(objective: str) -> str:
    """CTEs: own (row_id, split), grams (row_id, g) and pairs (a, b) with their shared share, all against all that share a five-word sequence."""
    return f"""texts AS (
              SELECT row_id, any_value(split) AS split, any_value({objective} array_to_string(list_transform(list_filter(messages, lambda m: m.role IN ('user', 'assistant') AND m.content IS NOT NULL), lambda m: m.content), chr(10))) AS c
              FROM release_rows WHERE row_id IS NOT NULL GROUP BY row_id),
            own AS (SELECT row_id, split, {words_sql("f")} AS w FROM (SELECT row_id, split, {_form("c")} AS f FROM texts)),
            grams AS (SELECT DISTINCT row_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM own)),
            sizes AS (SELECT row_id, count(*) AS n FROM grams GROUP BY row_id),
            met AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS inter FROM grams a JOIN grams b USING (g) WHERE a.row_id < b.row_id GROUP BY 1, 2),
            pairs AS (SELECT a, b, inter / (x.n + y.n - inter) AS share FROM met JOIN sizes x ON x.row_id = a JOIN sizes y ON y.row_id = b)"""


def oracle_sql() -> dict[str, str]:
    """Those whose result SQL can state without tokenizers and models, by comparing all with all; tests hold the others against brute force."""
    return {
        "p3_found": f"""WITH {_shares("'' ||")} SELECT a AS row_id_a, b AS row_id_b FROM pairs JOIN own x ON x.row_id = a JOIN own y ON y.row_id = b
            WHERE share >= 0.8 - 1e-9 AND (x.split = 'train') <> (y.split = 'train') AND x.split IN ('train', 'validation', 'test') AND y.split IN ('train', 'validation', 'test')""",
        "p4_found": f"""WITH said AS (
              SELECT DISTINCT row_id, CAST(u.i - 1 AS BIGINT) AS turn, messages[u.i].role AS role, messages[u.i].content AS c
              FROM release_rows, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i) u WHERE row_id IS NOT NULL),
            own AS (SELECT row_id, turn, c, {_form("c")} AS f FROM said WHERE role IN ('user', 'assistant') AND c IS NOT NULL)
            SELECT a.row_id AS row_id_a, a.turn AS turn_a, b.row_id AS row_id_b, b.turn AS turn_b FROM own a JOIN own b USING (f) WHERE a.row_id < b.row_id AND a.c <> b.c""",
        "p5_found": f"""WITH {_shares("coalesce(learning_objective, '') || chr(10) ||")} SELECT a AS row_id_a, b AS row_id_b FROM pairs WHERE share >= 0.6 - 1e-9""",
        "p7_found": f"""WITH said AS (
              SELECT DISTINCT row_id, i, messages[i].role AS role, messages[i].content AS c FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM release_rows WHERE row_id IS NOT NULL AND split = 'train')),
            own AS (SELECT row_id, i, {words_sql("f")} AS w FROM (SELECT row_id, i, {_form("c")} AS f FROM said WHERE role IN ('user', 'assistant') AND c IS NOT NULL)),
            held AS (SELECT scenario_id, turn, field, {words_sql("f")} AS w FROM (SELECT scenario_id, turn, field, {_form("c")} AS f FROM (
              SELECT id AS scenario_id, CAST(i AS BIGINT) AS turn, v.field, CASE WHEN v.field = 'user' THEN turns[i].user ELSE turns[i].expected END AS c
              FROM (SELECT id, turns, unnest(range(1, len(turns) + 1)) AS i FROM scenarios) s, (VALUES ('user'), ('expected')) v(field)) WHERE c IS NOT NULL)),
            suite AS (SELECT DISTINCT scenario_id, turn, field, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT scenario_id, turn, field, w, unnest(range(1, len(w) - 10)) AS k FROM held)),
            windows AS (SELECT DISTINCT row_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 10)) AS k FROM own))
            SELECT DISTINCT row_id, scenario_id, turn, field FROM windows JOIN suite USING (g)""",
        "p1_found": r"""
            WITH RECURSIVE own AS (
              SELECT row_id, max(split) AS split,
                     max(nullif(translate(lower(trim(provenance.source_group_id)), '_ ', '--'), '')) AS g,
                     max(CASE WHEN trim(provenance.source_family_key) <> '' THEN provenance.source_family_key END) AS f
              FROM release_rows WHERE row_id IS NOT NULL GROUP BY row_id),
            links AS (SELECT DISTINCT 'g' || g AS a, 'f' || f AS b FROM own WHERE g IS NOT NULL AND f IS NOT NULL),
            ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
            least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
            placed AS (
              SELECT row_id, split, coalesce(l.c, 'g' || g, 'f' || f) AS c
              FROM own LEFT JOIN least l ON l.a = coalesce('g' || g, 'f' || f)
              WHERE coalesce(g, f) IS NOT NULL),
            bad AS (SELECT c, min(row_id) AS group_row_id FROM placed GROUP BY c HAVING count(DISTINCT split) > 1)
            SELECT group_row_id, row_id FROM placed JOIN bad USING (c)""",
        "p2_found": r"""
            WITH said AS (
              SELECT DISTINCT row_id, CAST(u.i - 1 AS BIGINT) AS turn, messages[u.i].role AS role, messages[u.i].content AS content
              FROM release_rows, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i) u WHERE row_id IS NOT NULL),
            cut AS (
              SELECT row_id, turn, list_filter(string_split_regex(content, '[ \t\n]+'), lambda x: x <> '') AS w
              FROM said WHERE role IN ('user', 'assistant') AND content IS NOT NULL),
            windows AS (
              SELECT row_id, turn, array_to_string(w[u.i:u.i + 39], ' ') AS s
              FROM cut, LATERAL (SELECT unnest(range(1, len(w) - 38)) AS i) u),
            shared AS (SELECT s FROM windows GROUP BY s HAVING count(DISTINCT row_id) > 1)
            SELECT DISTINCT row_id, turn FROM windows JOIN shared USING (s)""",
    }
