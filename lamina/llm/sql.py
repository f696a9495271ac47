"""DuckDB SQL of the corpus queries that SQL can express.

The others are held against brute-force versions in tests/llm: tokenizers,
fingerprint hashes, media digests, markup, fitted models and raking have no
SQL form here.
"""

from .sharding import SEED, SHARDS

#: The base patterns, classes and allow-list, written out again so that an error in the operator's shows.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
RUNS = (("[0-9a-fA-F]{20,}", 3.1), ("[A-Za-z0-9]{20,}", 3.9), ("[A-Za-z0-9+/]{20,}", 3.9), ("[A-Za-z0-9_-]{20,}", 3.9))
PLACEHOLDER = "(?:example|placeholder|dummy|changeme|your|x{4,}|abcdefgh|0123456789|12345678)"
LISTED = " OR ".join(
    f"regexp_matches(val, '{p}')"
    for p in (
        "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        "^[A-Za-z_/-]*[/-][A-Za-z_/-]*$",
        "^[a-z]+$",
        "^[A-Z]+$",
        "^[A-Z]?[a-z]+([A-Z][a-z]+)*$",
        "^[0-9+/_-]+$",
        f"(?i)^{PLACEHOLDER}([^A-Za-z]|$)",
        f"(?i)(^|[^A-Za-z]){PLACEHOLDER}$",
    )
)


def _spans(kind: int, pattern: str, wanted: str = "TRUE", group: int = 0, extra: str = "") -> str:
    """Spans of a pattern: lengths of the matches and of the text between them give the positions."""
    before = "coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)"
    cuts = f"regexp_extract_all(t, '{pattern}') AS hit, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}', {group}) AS val"
    return f"SELECT r, {kind} AS kind, {before} AS s, length(hit[i]) AS size, val[i] AS val{extra} FROM (SELECT r, {cuts} FROM docs) m, unnest(range(1, len(hit) + 1)) u(i) WHERE {wanted}"


SECRETS = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({_spans(0, ASSIGN, "length(val[i]) >= 6", 2)} UNION ALL {_spans(1, "AKIA[A-Z0-9]{16,}")} UNION ALL {_spans(2, "[0-9a-f]{24,}")}),
run AS ({" UNION ALL ".join(_spans(3, p, extra=f", {limit} AS least") for p, limit in RUNS)}),
candidate AS MATERIALIZED (SELECT r, s, size, val, min(least) AS least FROM run WHERE NOT ({LISTED}) GROUP BY ALL),
counted AS (SELECT r, s, size, least, k, substr(val, k + j, 1) AS ch, count(*) AS n FROM candidate, unnest(range(1, length(val) - 18)) w(k), unnest(range(0, 20)) p(j) GROUP BY ALL),
bits AS (SELECT r, s, size, least, k, sum(-n / 20.0 * log2(n / 20.0)) AS h FROM counted GROUP BY ALL),
entropy AS MATERIALIZED (SELECT r, 3 AS kind, s, size FROM bits GROUP BY r, s, size, least HAVING max(h) >= least),
found AS MATERIALIZED (SELECT r, kind, s, size FROM base UNION ALL SELECT * FROM entropy),
every AS (SELECT r, kind, s, size FROM base UNION ALL SELECT * FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.r = e.r AND b.s <= e.s AND b.s + b.size >= e.s + e.size AND (b.kind < 3 OR b.size > e.size))),
spelled AS (SELECT r, kind, (CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END) || ':' || s || ':' || (s + size) AS span, s FROM every)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM docs d LEFT JOIN spelled p ON d.r = p.r GROUP BY d.r, d.doc_id"""

#: CRC-32 one byte at a time over the hexadecimal text of the bytes; the table comes from its rule.
CRC_TABLE = "(SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"

SHARDING = f"""WITH sized AS MATERIALIZED (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS bytes,
CAST('0x' || substr(md5('{SEED}/' || coalesce('s:' || source, 'n')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
digested AS MATERIALIZED (SELECT doc_id, source, CAST(size AS BIGINT) AS size, u,
xor(list_reduce([4294967295] || list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || bytes[i:i + 1] AS BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM sized, {CRC_TABLE}),
summed AS MATERIALIZED (SELECT *, substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' || text_crc32), 1, 13) AS draw FROM digested),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS LAST, size, text_crc32) AS rank, count(*) OVER (PARTITION BY source) AS n FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY (rank - u) / n, source NULLS LAST, draw, doc_id NULLS LAST, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, pos * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM cut"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
TOP_K = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {FINITE}),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 20"""



def _crc(text: str) -> str:
    """CRC-32 of a text; ``crc`` of CRC_TABLE has to be in scope."""
    return f"xor(list_reduce([4294967295] || list_transform(range(1, length(hex(encode({text}))), 2), lambda i: CAST('0x' || hex(encode({text}))[i:i + 1] AS BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode(CAST({name} AS VARCHAR))) || ':' || {name}, '-')"


def _tree(name: str, leaves: str, key: str, levels: int) -> str:
    """CTEs of the levels of trees over ``leaves`` (key, idx, digest), and of each leaf's siblings on the way up."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT {key} AS k, idx, digest, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for i in range(levels):
        made = "CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END"
        steps.append(f"{name}{i + 1} AS MATERIALIZED (SELECT k, idx // 8 AS idx, {made} AS digest, count(*) OVER (PARTITION BY k) AS n FROM {name}{i} GROUP BY k, idx // 8)")
    for i in range(levels):
        beside = lambda sign: f"coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx {sign} o.idx), '')"
        steps.append(f"{name}s{i} AS MATERIALIZED (SELECT o.k, o.idx, o.n, {beside('<')} AS l, {beside('>')} AS r FROM {name}{i} o JOIN {name}{i} s ON o.k IS NOT DISTINCT FROM s.k AND o.idx // 8 = s.idx // 8 GROUP BY o.k, o.idx, o.n)")
    return ",\n".join(steps)


#: Levels of the language trees and of the tree above them: enough for 16 million rows of a language and 512 languages.
LEVELS, ABOVE = 8, 3
_folds, _last = [], "way"
for _i in range(LEVELS):
    _folds.append(f"f{_i} AS (SELECT w.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || w.folded || s.r) ELSE w.folded END AS folded, w.proof || s.l || s.r AS proof) FROM {_last} w JOIN ts{_i} s ON w.lang IS NOT DISTINCT FROM s.k AND w.idx // {8**_i} = s.idx)")
    _last = f"f{_i}"
for _i in range(ABOVE):
    _folds.append(f"g{_i} AS (SELECT w.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || w.folded || s.r) ELSE w.folded END AS folded, w.proof || s.l || s.r AS proof) FROM {_last} w JOIN us{_i} s ON w.top // {8**_i} = s.idx)")
    _last = f"g{_i}"
_leaf = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
_moved = _leaf.replace(_field("text"), _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
MERKLE = f"""WITH rows AS MATERIALIZED (SELECT doc_id, lang, sha256({_leaf}) AS digest, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_moved}) ELSE sha256({_leaf}) END AS now FROM documents, {CRC_TABLE}),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM rows),
{_tree("t", "leaves", "lang", LEVELS)},
subroots AS MATERIALIZED (SELECT k AS lang, digest, 0 AS one, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 AS idx FROM t{LEVELS}),
{_tree("u", "subroots", "one", ABOVE)},
way AS (SELECT v.doc_id, v.lang, v.idx, v.digest AS leaf, s.digest AS subroot, s.idx AS top, (SELECT digest FROM u{ABOVE}) AS root, v.now AS folded, '' AS proof FROM leaves v JOIN subroots s ON v.lang IS NOT DISTINCT FROM s.lang),
{", ".join(_folds)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {_last}"""

ORACLE: dict[str, str] = {"op6_secret_scan": SECRETS, "op7_stratified_sharding": SHARDING, "op12_merkle_manifest": MERKLE, "op13_exact_topk": TOP_K}
