"""Small release rows, and the rules stated once more in plain Python."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import pyarrow as pa

SCHEMA = (
    "row_id bigint, split string, language string, scenario_family string, learning_objective string, messages array<struct<role:string,content:string>>, "
    "provenance struct<source_family:string,source_group_id:string,source_family_key:string>, text string, side string, n string, k string, tokens string, rank int, block string"
)


def rows(spark, specs):
    """specs: dicts with row_id and any of split, said (contents after the system message), group, key ... Other columns carry names that operators use inside."""
    out = []
    for s in specs:
        said = s.get("said", [])
        messages = s["messages"] if "messages" in s else [("system", "same")] + [(("user", "assistant")[i % 2], c) for i, c in enumerate(said)]
        out.append((s["row_id"], s.get("split", "train"), s.get("language", "en"), s.get("family", "panic"), s.get("objective", "explain it"), messages, s.get("provenance", (s.get("source", "src"), s.get("group"), s.get("key"))), "clash", "clash", "clash", "clash", "clash", 7, "clash"))
    return spark.createDataFrame(out, SCHEMA)


def words(text):
    from qanat.llm.textcore import consistent_form

    text = consistent_form(pa.array([text or ""])).to_pylist()[0]
    return re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", unicodedata.normalize("NFKC", text).casefold().replace("’", "'"))


def grams(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def spoken(spec):
    if "messages" in spec:
        return [c for m in spec["messages"] or [] if m for r, c in [m] if r in ("user", "assistant") and c is not None]
    return [c for c in spec.get("said", []) if c is not None]


def near(specs, t, objective):
    sets = {}
    for s in specs:
        if s["row_id"] is not None:
            ws = words(s.get("objective", "explain it")) if objective else []
            for c in spoken(s):
                ws += words(c)
            sets[s["row_id"]] = grams(ws, 5)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}
