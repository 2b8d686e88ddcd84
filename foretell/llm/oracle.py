"""DuckDB SQL for the queries that SQL can express."""


def _tree_levels(nodes: str, name: str, levels: int) -> str:
    """CTEs <name>0 .. <name><levels>: the levels over nodes (key, pos, h, n), as far as a key has several nodes."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT key, pos, h, n FROM {nodes})"]
    for k in range(1, levels + 1):
        ctes.append(
            f"{name}{k} AS MATERIALIZED (SELECT key, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (max(n) + 2) // 3 AS n"
            f" FROM {name}{k - 1} GROUP BY key, pos // 3)"
        )
    return ",\n".join(ctes)


def _proof_levels(start: str, name: str, tree: str, levels: int) -> str:
    """CTEs <name>0 .. <name><levels>: rows of start (id, key, pos, proof, folded) with the siblings of each level of the tree."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT id, key, pos, proof, folded FROM {start})"]
    for k in range(levels):
        side = lambda there: f"coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos {there} p.pos), '')"
        ctes.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT p.id, p.key, p.pos // 3 AS pos, any_value(p.proof) || {side('<>')} AS proof,"
            f" CASE WHEN any_value(t.n) > 1 THEN sha256({side('<')} || any_value(p.folded) || {side('>')}) ELSE any_value(p.folded) END AS folded"
            f" FROM {name}{k} p JOIN {tree}{k} t ON p.key IS NOT DISTINCT FROM t.key AND p.pos // 3 = t.pos // 3 GROUP BY p.id, p.key, p.pos)"
        )
    return ",\n".join(ctes)


def _merkle(levels: int = 12, top: int = 8) -> str:
    """For at most 3 ** levels rows of a source and 3 ** top sources."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    even = """(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) & 1) = 1"""
    return f"""
WITH l AS MATERIALIZED (SELECT doc_id, source AS key, {leaf("text")} AS h, CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed FROM documents),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
{_tree_levels("m", "s", levels)},
r AS MATERIALIZED (SELECT 0 AS key, key AS source, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM s{levels}),
{_tree_levels("r", "t", top)},
{_proof_levels("(SELECT doc_id AS id, key, pos, '' AS proof, changed AS folded FROM m)", "p", "s", levels)},
{_proof_levels(f"(SELECT p.id, 0 AS key, r.pos, p.proof, p.folded FROM p{levels} p JOIN r ON p.key IS NOT DISTINCT FROM r.source)", "q", "t", top)}
SELECT m.doc_id, m.h AS leaf, r.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root, q.folded = t.h AS verified
FROM m JOIN r ON m.key IS NOT DISTINCT FROM r.source JOIN q{top} q ON q.id = m.doc_id CROSS JOIN t{top} t
"""


def _product_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    ctes = []
    for k in range(rounds + 1):
        ctes.append(
            f"a{k} AS MATERIALIZED (SELECT v.vec_id, v.p, min({{'far': list_sum(list_transform(list_zip(v.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), 'e': c.e}}) AS m FROM v JOIN c{k} c ON v.p = c.p GROUP BY v.vec_id, v.p)"
        )
        if k < rounds:
            ctes.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x"
                f" FROM (SELECT v.p, a.m.e AS e, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS i FROM v JOIN a{k} a ON v.vec_id = a.vec_id AND v.p = a.p) GROUP BY p, e, i) GROUP BY p, e) n ON c.p = n.p AND c.e = n.e)"
            )
    chain = ",\n".join(ctes)
    return f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, nth, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM w, range({parts}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, nth AS e, x FROM v WHERE nth < {entries}),
{chain},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
d AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT d.vec_id, d.code, d.error, CAST(sum(d.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, b.h AS codebooks_sha256 FROM d JOIN w ON d.vec_id = w.vec_id CROSS JOIN b
"""


ORACLE_SQL = {
    "op3_vector_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept, h AS text_sha256
FROM d
""",
    "op10_chat_format": r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\\[<]', '', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op11_merkle_manifest": _merkle(),
    "op12_line_dedup": r"""
WITH l AS MATERIALIZED (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS MATERIALIZED (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.key IS NOT NULL AND c.least <> k.doc_id AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op13_product_codes": _product_codes(),
}
