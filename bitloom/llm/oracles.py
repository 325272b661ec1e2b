"""DuckDB text of the queries that SQL can express, by brute force over all words."""

from __future__ import annotations

import string

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACE = r"'[\x20\x09-\x0D]+'"
_BETWEEN = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(text: str, between: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {between}), lambda x: x <> '')"


OP3 = f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACE)} w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) s FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least_doc FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) p FROM win JOIN f USING (g) WHERE least_doc < doc_id)),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, {_words(_LOW, _BETWEEN)} w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) item_id, {_words(_LOW, _BETWEEN)} w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') g, least(10, len(w)) z FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT z FROM iw),
dw AS (SELECT doc_id, s, z, array_to_string(w[s:s + z - 1], ' ') g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) s FROM d, sizes WHERE len(w) >= z)),
hit AS (SELECT doc_id, s, z, item_id FROM dw JOIN iw USING (g, z)),
cov AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(s, s + z)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) k, string_agg(item_id, ',' ORDER BY item_id) l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) t FROM d),
cnt AS (SELECT t, count(*) n FROM tok GROUP BY t),
arr AS (SELECT DISTINCT item_id, w[k:k + 9] a FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) k FROM i WHERE len(w) > 0)),
each AS (SELECT item_id, a, unnest(range(len(a))) o, unnest(a) t FROM arr),
rare AS (SELECT item_id, a, arg_min({{'t': t, 'o': o}}, n * 100 + o) r FROM each JOIN cnt USING (t) GROUP BY item_id, a HAVING count(*) = len(a)),
near AS (SELECT d.doc_id, count(DISTINCT item_id) n_near FROM rare JOIN tok ON tok.t = r.t JOIN d USING (doc_id) WHERE list_has_all(w[greatest(1, p - r.o - 3):greatest(0, p - r.o + len(a) + 2)], a) GROUP BY d.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_hit, coalesce(k, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n, 0) > 0 contaminated, coalesce(n_near, 0) n_near FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW, _SPACE)} w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id a, doc_id b FROM d UNION SELECT a, y FROM reach JOIN both_ways ON x = b)
SELECT d.doc_id, coalesce(any_value(n), 0) n_shingles, min(b) component_id, d.doc_id = min(b) kept FROM d LEFT JOIN n USING (doc_id) JOIN reach ON a = d.doc_id GROUP BY d.doc_id"""

ORACLES = {"op3_substring_dedup": OP3, "op7_decontaminate": OP7, "op10_near_dedup": OP10}
