"""The registered queries restated as SQL over the same tables, for comparison in DuckDB.

Written from the meaning of each query: table expressions below mirror ``tables.py``; the queries use
set operators, anti-joins and correlated lookups where the Spark side uses grouped aggregates.
"""

from __future__ import annotations

from driftlens.functions import fixed_values as V
from driftlens.plans import tables as T
from driftlens.plans.oracle_scripts import SCRIPT_ERRORS

ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[({index})::BIGINT + 1]"


def _regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


RANK = "CASE severity WHEN 'BLOCK' THEN 0 WHEN 'WARN' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END"
LABEL = "CASE {0} WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'WARN' WHEN 2 THEN 'INFO' ELSE 'CLEAN' END"
DIRECTION = "CASE WHEN from_ver IS NULL THEN 'added' ELSE 'changed' END"

LOCK = """
lock_base AS (
  SELECT p_brand AS run_id, p_name || '-' || p_brand AS name, '1.' || p_size || '.' || (p_partkey % 4) AS version,
    'node_modules/' || p_name || '-' || p_brand || '#' || p_partkey AS key, p_partkey AS ord,
    CASE WHEN p_partkey % 11 = 0 THEN 'git+ssh://host.example/' || p_partkey
         WHEN p_partkey % 11 = 1 THEN 'file:///opt/' || p_partkey END AS resolved,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE (p_partkey % 50)::VARCHAR END AS kept,
    CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN (p_partkey % 50 + 1)::VARCHAR
         ELSE (p_partkey % 50)::VARCHAR END AS moved
  FROM part),
lock_nodes AS (
  SELECT run_id, 'old' AS side, key, name, version, kept AS integrity, resolved, ord FROM lock_base WHERE ord % 5 <> 0 OR ord % 35 = 0
  UNION ALL
  SELECT run_id, 'new', key, name, version, moved, resolved, ord FROM lock_base WHERE ord % 7 <> 0 OR ord % 35 = 0),
last_entry AS (
  SELECT run_id, side, name, version, arg_max(key, ord) AS key, arg_max(integrity, ord) AS integrity,
    arg_max(COALESCE(resolved, ''), ord) AS resolved, min(ord) AS first_ord,
    split_part(version, '.', 2)::BIGINT * 1000 + split_part(version, '.', 3)::BIGINT AS num
  FROM lock_nodes GROUP BY run_id, side, name, version),
o AS (SELECT * FROM last_entry WHERE side = 'old'),
w AS (SELECT * FROM last_entry WHERE side = 'new'),
arrived AS (
  SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM o WHERE o.run_id = w.run_id AND o.name = w.name)
    AND NOT EXISTS (SELECT 1 FROM o WHERE o.run_id = w.run_id AND o.name = w.name AND o.version = w.version)),
prior AS (
  SELECT a.run_id, a.name, a.version,
    COALESCE(arg_max(o.version, (o.num, o.first_ord)) FILTER (WHERE o.num <= a.num),
             arg_min(o.version, (o.num, o.first_ord)) FILTER (WHERE o.num > a.num)) AS version_old
  FROM arrived a JOIN o ON o.run_id = a.run_id AND o.name = a.name GROUP BY a.run_id, a.name, a.version),
changes AS (
  SELECT w.run_id, 'integrity-changed' AS kind, w.name, o.key AS key_old, w.key AS key_new, o.version AS version_old,
    w.version AS version_new, o.integrity AS integrity_old, w.integrity AS integrity_new, w.resolved AS resolved_new
  FROM w JOIN o USING (run_id, name, version) WHERE w.integrity <> o.integrity
  UNION ALL
  SELECT w.run_id, 'added', w.name, NULL, w.key, NULL, w.version, NULL, w.integrity, w.resolved FROM w
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.run_id = w.run_id AND o.name = w.name)
  UNION ALL
  SELECT o.run_id, 'removed', o.name, o.key, NULL, o.version, NULL, o.integrity, NULL, NULL FROM o
  WHERE NOT EXISTS (SELECT 1 FROM w WHERE o.run_id = w.run_id AND o.name = w.name)
  UNION ALL
  SELECT a.run_id, 'upgraded', a.name, o.key, a.key, o.version, a.version, o.integrity, a.integrity, a.resolved
  FROM arrived a JOIN prior p USING (run_id, name, version)
  JOIN o ON o.run_id = a.run_id AND o.name = a.name AND o.version = p.version_old)
"""


def _flat_select(detector, severity, confidence, file, line, snippet, source, extra="") -> str:
    return f"""SELECT run_id, change_id, {detector} AS detector, package, from_ver, to_ver, {DIRECTION} AS direction,
      {severity} AS severity, {confidence} AS confidence, {file} AS file, ({line})::INTEGER AS line,
      substr({snippet}, 1, 240) AS snippet FROM {source} {extra}"""


ORACLE["changeset_diff"] = f"WITH {LOCK} SELECT * EXCLUDE (resolved_new) FROM changes"
ORACLE["closest_version_asof"] = f"WITH {LOCK} SELECT run_id, name, version_new, version_old FROM changes WHERE kind = 'upgraded'"
ORACLE["change_kinds"] = f"WITH {LOCK} SELECT run_id, kind, count(*) AS n FROM changes GROUP BY run_id, kind"
ORACLE["integrity_mismatch"] = f"""WITH {LOCK}
SELECT run_id, 'integrity-changed:' || name || ':' || version_new AS change_id, 'integrity.hash-mismatch' AS detector,
  name AS package, version_old AS from_ver, version_new AS to_ver, 'changed' AS direction, 'BLOCK' AS severity,
  'high' AS confidence, 'package.json' AS file, 1::INTEGER AS line,
  'integrity ' || CASE WHEN integrity_old = '' THEN '<missing>' ELSE integrity_old END || ' → ' || integrity_new AS snippet
FROM changes WHERE kind = 'integrity-changed'"""
ORACLE["unusual_sources"] = f"""WITH {LOCK},
s AS (SELECT *, CASE WHEN resolved_new LIKE 'git+%' THEN 'git' WHEN resolved_new LIKE 'file:///%' THEN 'file' END AS src
  FROM changes WHERE kind <> 'removed'),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, name, src ORDER BY kind, version_new) AS rn FROM s WHERE src IS NOT NULL)
SELECT run_id, kind || ':' || name || ':' || version_new AS change_id,
  CASE src WHEN 'git' THEN 'deps.non-registry-source' ELSE 'deps.local-source' END AS detector, name AS package,
  CASE src WHEN 'git' THEN version_old END AS from_ver, version_new AS to_ver,
  CASE kind WHEN 'added' THEN 'added' ELSE 'changed' END AS direction,
  CASE src WHEN 'git' THEN 'WARN' ELSE 'INFO' END AS severity, CASE src WHEN 'git' THEN 'high' ELSE 'medium' END AS confidence,
  key_new AS file, 1::INTEGER AS line, 'resolved: ' || resolved_new AS snippet
FROM f WHERE rn = 1 AND (src = 'git' OR kind = 'added')"""
ORACLE["fail_closed"] = f"""WITH {LOCK},
bad AS (SELECT run_id, name, version FROM lock_nodes WHERE integrity = '' GROUP BY run_id, name, version),
m AS (SELECT b.run_id, b.name, b.version, c.kind, c.version_old FROM bad b
  LEFT JOIN changes c ON c.run_id = b.run_id AND c.name = b.name AND c.version_new = b.version),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY (kind IS NULL)::INT, version) AS rn FROM m)
SELECT run_id, name AS package, CASE WHEN kind IS NULL THEN version ELSE version_old END AS from_ver,
  CASE WHEN kind IS NULL THEN NULL ELSE version END AS to_ver,
  CASE WHEN kind = 'added' THEN 'added' ELSE 'changed' END AS direction, 'BLOCK' AS severity, 'analysis.failed' AS detector
FROM f WHERE rn = 1"""
ORACLE["workspace_links"] = f"""WITH {LOCK}
SELECT run_id, 'link:' || key AS change_id, 'deps.workspace-shadowing' AS detector, name AS package, NULL::VARCHAR AS from_ver,
  version AS to_ver, 'added' AS direction,
  CASE WHEN name IN (SELECT name FROM lock_nodes WHERE resolved IS NULL) THEN 'BLOCK' ELSE 'WARN' END AS severity,
  'medium' AS confidence, key AS file, 1::INTEGER AS line,
  '"link": true, "name": "' || name || '", "resolved": "' || COALESCE(resolved, '') || '"' AS snippet
FROM lock_nodes WHERE side = 'new'"""
ORACLE["aliased_names"] = f"""WITH {LOCK},
a AS (SELECT run_id, name, 'real-' || integrity AS real_name, arg_min(version, ord) AS version
  FROM lock_nodes WHERE side = 'new' GROUP BY ALL)
SELECT run_id, 'alias:' || name || ':' || real_name AS change_id, 'deps.aliased-name' AS detector, name AS package,
  NULL::VARCHAR AS from_ver, version AS to_ver, 'added' AS direction, 'WARN' AS severity, 'high' AS confidence,
  'node_modules/' || name AS file, 1::INTEGER AS line, name || '@npm:' || real_name || '@' || version AS snippet FROM a"""

FACTS = f"""
fact_base AS (
  SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
    (l_orderkey + (l_suppkey % 2) * l_linenumber) % 9 AS idx, l_suppkey % 4 = 0 AS is_added,
    {_pick(T.CAPS, 'l_partkey % 12')} AS cap, 'lib/f' || (l_orderkey % 23) || '.js' AS src,
    {_pick(T.WASM_MODULES, 'l_orderkey % 4')} AS wm, {_pick(T.WASM_NAMES, 'l_linenumber % 5')} AS wn
  FROM lineitem),
fact_kind AS (
  SELECT *, CASE cap WHEN 'dynamic_code' THEN {_pick(T.CODE, 'o % 6')} WHEN 'encoded_url' THEN {_pick(['base64', 'hex'], 'n % 2')}
      WHEN 'artifact' THEN 'node' WHEN 'wasm_import' THEN wn END AS kind,
    CASE WHEN p % 24 = 5 THEN 'dns.lookup(process.env.A)' WHEN p % 48 IN (9, 6) THEN 'pаypal'
      ELSE 'read _0x' || substr(md5((p % 97)::VARCHAR), 1, 4) || ' end' END AS words,
    'bin/n' || idx || '.node' AS bin, 'bin/w' || (o % 3) || '.wasm' AS wasm
  FROM fact_base),
fact_key AS (
  SELECT *, CASE cap WHEN 'net_module' THEN {_pick(T.NET, 'idx')} WHEN 'exec_module' THEN {_pick(T.EXEC, 'idx')}
      WHEN 'fs_module' THEN 'fs' WHEN 'url' THEN 'https://h' || (p % 40) || '.example/p' || idx
      WHEN 'encoded_url' THEN 'https://x' || idx || '.invalid/c' WHEN 'env' THEN {_pick(T.ENV, 'idx')}
      WHEN 'dynamic_code' THEN src || ':' || n || ':' || kind WHEN 'fs_write' THEN {_pick(T.WRITES, 'idx')}
      WHEN 'fs_read' THEN {_pick(T.READS, 'idx')} WHEN 'artifact' THEN bin || '|' || md5((p % 5)::VARCHAR)
      WHEN 'wasm_import' THEN wasm || '|' || wm || '|' || wn ELSE '' END AS key
  FROM fact_kind),
facts AS (
  SELECT 'r' || (s % 7) AS run_id, 's' || s AS change_id, 'pkg-' || s AS package,
    CASE WHEN NOT is_added THEN '1.0.0' END AS from_ver, '2.0.0' AS to_ver,
    CASE WHEN NOT is_added AND o % 3 = 0 THEN 'old' ELSE 'new' END AS side,
    CASE cap WHEN 'artifact' THEN bin WHEN 'wasm_import' THEN wasm ELSE src END AS path, cap, key, n::INTEGER AS line,
    CASE WHEN cap = 'url' THEN key ELSE words END AS snippet,
    CASE WHEN cap = 'url' AND o % 5 < 4 THEN {_pick(T.CONTEXTS, 'o % 5 % 4')} WHEN cap = 'wasm_import' THEN wm END AS context,
    kind, (o * 8 + n) * 1000000 + p AS ord
  FROM fact_key)
"""
HOT = _regex("(?i)" + "|".join(V.HOT_PATHS_ANY_CASE)), _regex("|".join(V.HOT_PATHS_EXACT_CASE))
SENSITIVE = f"(key = '*' OR list_has_any(string_split(key, ','), {_list(V.SENSITIVE_ENV_KEYS)}))"
WASM_BARE = r"trim(regexp_replace(kind, '(?i)\s+as\s+[\w$.-]+\z', ''))"
WASM_HIT = f"""((regexp_matches(context, {_regex(V.WASI_MODULE)}) AND regexp_matches({WASM_BARE}, {_regex(V.WASI_NAMES)}))
  OR (regexp_matches(context, {_regex(V.WASM_HOST_MODULE)}) AND (regexp_matches({WASM_BARE}, {_regex(V.WASM_NAMES)})
  OR regexp_matches(context || '.' || {WASM_BARE}, {_regex(V.WASM_NAMES)}))))"""
SCORE = r"""CASE WHEN cap = 'url' THEN (CASE context WHEN 'network-arg' THEN 40 WHEN 'config-value' THEN 30 WHEN 'literal' THEN 20
  WHEN 'comment' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)\.[cm]?[jt]sx?\z') THEN 5
  WHEN regexp_matches(path, '(?i)\.json\z') THEN 3 ELSE 1 END) * 1000 + greatest(0, 240 - length(snippet)) ELSE 0 END"""
DELTA = FACTS + f""",
wanted AS (SELECT *, {SCORE} AS score FROM facts WHERE cap IN ('net_module','exec_module','url','encoded_url','dynamic_code','artifact')
  OR (cap IN ('fs_write','fs_read') AND (regexp_matches(key, {HOT[0]}) OR regexp_matches(key, {HOT[1]})))
  OR (cap = 'env' AND {SENSITIVE}) OR (cap = 'wasm_import' AND {WASM_HIT})),
fresh AS (SELECT *, row_number() OVER (PARTITION BY change_id, cap, key ORDER BY score DESC, ord) AS rn,
    count(*) OVER (PARTITION BY change_id, cap, key) AS sightings
  FROM wanted x WHERE side = 'new' AND NOT EXISTS (
    SELECT 1 FROM wanted y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.cap = x.cap AND y.key = x.key)),
chosen AS (SELECT * FROM fresh WHERE rn = 1)
"""
CAP_DETECTOR = """CASE cap WHEN 'net_module' THEN 'net.new-module' WHEN 'url' THEN 'net.new-endpoint'
  WHEN 'encoded_url' THEN 'net.encoded-endpoint' WHEN 'exec_module' THEN 'exec.new-module' WHEN 'fs_write' THEN 'fs.new-hotpath-write'
  WHEN 'fs_read' THEN 'fs.new-hotpath-read' WHEN 'env' THEN 'env.token-harvest' WHEN 'dynamic_code' THEN 'code.dynamic-loading-added'
  WHEN 'artifact' THEN 'bin.new-native-artifact' ELSE 'wasm.suspicious-import' END"""
CAP_SEVERITY = """CASE WHEN cap IN ('net_module','exec_module') THEN 'WARN'
  WHEN cap = 'url' THEN CASE WHEN context IN ('literal','comment') THEN 'INFO' ELSE 'WARN' END
  WHEN cap = 'dynamic_code' THEN CASE WHEN kind = 'vm' THEN 'BLOCK' WHEN kind IN ('eval','new-function','char-arithmetic-decoder')
    THEN 'WARN' ELSE 'INFO' END ELSE 'BLOCK' END"""
CAP_CONFIDENCE = """CASE WHEN cap IN ('net_module','exec_module','url') THEN CASE WHEN from_ver IS NULL THEN 'low' ELSE 'medium' END
  WHEN cap = 'dynamic_code' THEN CASE WHEN kind = 'vm' THEN 'high' WHEN kind IN ('eval','new-function','char-arithmetic-decoder')
    THEN 'medium' ELSE 'low' END ELSE 'high' END"""


def _delta_query(where: str) -> str:
    rows = f"(SELECT c.* FROM chosen c, range(CASE WHEN c.cap = 'dynamic_code' THEN c.sightings ELSE 1 END) r WHERE {where})"
    return f"WITH {DELTA} " + _flat_select(CAP_DETECTOR, CAP_SEVERITY, CAP_CONFIDENCE, "path", "line", "snippet", rows)


ORACLE["new_capability_delta"] = _delta_query("true")
ORACLE["env_harvest"] = _delta_query("cap = 'env'")
ORACLE["native_artifact_delta"] = _delta_query("cap = 'artifact'")
ORACLE["wasm_import_filter"] = _delta_query("cap = 'wasm_import'")
ORACLE["hotpath_filter"] = "SELECT change_id, detector, package, severity, file, line FROM (" + _delta_query("cap IN ('fs_write','fs_read')") + ")"
ORACLE["new_endpoint_best_evidence"] = f"WITH {DELTA} SELECT change_id, key, path, line, context, sightings FROM chosen WHERE cap = 'url'"
ORACLE["dynamic_code_tier"] = f"""WITH {DELTA} SELECT change_id, kind AS code_kind, {CAP_SEVERITY} AS severity,
  {CAP_CONFIDENCE} AS confidence, sum(sightings)::BIGINT AS sites FROM chosen WHERE cap = 'dynamic_code' GROUP BY ALL"""
ORACLE["url_context_merge"] = f"""WITH {FACTS} SELECT change_id, side, path, key, (list(context ORDER BY CASE context
  WHEN 'network-arg' THEN 3 WHEN 'config-value' THEN 2 WHEN 'literal' THEN 1 WHEN 'comment' THEN 0 END DESC NULLS LAST))[1] AS context
  FROM facts WHERE cap = 'url' GROUP BY change_id, side, path, key"""
ORACLE["network_argument_pairs"] = f"""WITH {FACTS} SELECT DISTINCT run_id, change_id FROM facts x WHERE cap = 'url' AND side = 'new'
  AND COALESCE(context, '') NOT IN ('literal','comment','config-value') AND NOT EXISTS (
  SELECT 1 FROM facts y WHERE y.cap = 'url' AND y.side = 'old' AND y.change_id = x.change_id AND y.key = x.key)"""
ORACLE["first_version_cluster"] = f"""WITH {FACTS},
seen AS (SELECT run_id, change_id, package, from_ver, to_ver, CASE WHEN cap = 'net_module' THEN 'NET' WHEN cap = 'exec_module' THEN 'EXEC'
    WHEN cap = 'fs_module' THEN 'FS' WHEN cap = 'env' AND {SENSITIVE} THEN 'ENV' WHEN cap = 'dynamic_code' THEN 'CODE'
    WHEN cap = 'suspicious_literal' THEN 'OBF' END AS flag, path FROM facts WHERE from_ver IS NULL AND side = 'new'),
g AS (SELECT run_id, change_id, package, from_ver, to_ver, list_sort(list(DISTINCT flag) FILTER (WHERE flag IS NOT NULL)) AS flags,
    count(DISTINCT path) AS files FROM seen GROUP BY ALL HAVING count(DISTINCT flag) >= 4)
""" + _flat_select("'deps.first-version-cluster'", "'BLOCK'", "'high'", "'package.json'", "1",
                   "'first-version-with-cluster: ' || array_to_string(flags, ', ') || ' across ' || files || ' file(s)'", "g")
ORACLE["dns_templated"] = f"""WITH {FACTS},
dns AS (SELECT * FROM facts WHERE cap = 'net_module' AND key IN {_in(V.DNS_MODULES)}),
here AS (SELECT DISTINCT run_id, change_id, package, from_ver, to_ver, path FROM dns x WHERE side = 'new' AND (from_ver IS NULL OR NOT EXISTS
  (SELECT 1 FROM dns y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.key = x.key))),
sign AS (SELECT DISTINCT change_id, path FROM facts WHERE side = 'new' AND ((cap = 'dynamic_code' AND kind = 'char-arithmetic-decoder')
  OR cap = 'encoded_url' OR (cap IN ('env','dynamic_code') AND regexp_matches(snippet, {_regex(V.DNS_CALLEE)})))),
j AS (SELECT h.* FROM here h JOIN sign USING (change_id, path))
SELECT run_id, change_id, 'net.dns-templated-hostname' AS detector, package, from_ver, to_ver, {DIRECTION} AS direction, 'WARN' AS severity,
  CASE WHEN from_ver IS NULL THEN 'low' ELSE 'medium' END AS confidence, path AS file, 1::INTEGER AS line FROM j"""

SCRIPTS = f"""
scripts AS (
  SELECT 'r' || (o_custkey % 60 % 7) AS run_id, 's' || (o_custkey % 60) AS change_id, 'pkg-' || (o_custkey % 60) AS package,
    CASE WHEN o_custkey % 60 % 4 <> 0 THEN '1.0.0' END AS from_ver, '2.0.0' AS to_ver,
    CASE WHEN o_custkey % 60 % 4 <> 0 AND month(o_orderdate) % 2 = 0 THEN 'old' ELSE 'new' END AS side,
    {_pick(T.HOOKS, '(o_orderkey + o_custkey) % 8')} AS hook, 'node ' || lower(o_orderstatus) || year(o_orderdate) || '.js' AS body
  FROM orders)
"""
HOOK_SEVERITY = f"""CASE WHEN hook IN {_in(V.INSTALL_HOOKS)} THEN 'BLOCK' WHEN hook IN {_in(V.PREPARE_HOOKS)} THEN 'INFO'
  WHEN hook IN {_in(V.PUBLISH_HOOKS)} THEN 'WARN' WHEN hook IN {_in(V.CI_HOOKS)} THEN 'INFO' END"""
HOOK_CONFIDENCE = f"""CASE WHEN hook IN {_in(V.INSTALL_HOOKS)} THEN 'high' WHEN hook IN {_in(V.PREPARE_HOOKS)} THEN 'medium'
  WHEN hook IN {_in(V.PUBLISH_HOOKS)} THEN 'medium' ELSE 'low' END"""
ORACLE["script_tier"] = f"""WITH {SCRIPTS},
one AS (SELECT run_id, change_id, package, from_ver, to_ver, side, hook, min(body) AS body FROM scripts GROUP BY ALL),
d AS (SELECT n.*, p.body AS before FROM one n LEFT JOIN one p ON p.side = 'old' AND p.change_id = n.change_id AND p.hook = n.hook
  WHERE n.side = 'new' AND {HOOK_SEVERITY.replace('hook IN', 'n.hook IN')} IS NOT NULL AND n.body IS DISTINCT FROM p.body)
""" + _flat_select("CASE WHEN before IS NULL THEN 'install.script-added' ELSE 'install.script-changed' END", HOOK_SEVERITY,
                   HOOK_CONFIDENCE, "'package.json'", "1", "hook || ': ' || substr(body, 1, 200)", "d")
SHAPE_RANK = "CASE hook WHEN 'preinstall' THEN 0 WHEN 'install' THEN 1 WHEN 'postinstall' THEN 2 WHEN 'prepare' THEN 3 END"
ORACLE["self_publish_shape"] = f"""WITH {FACTS}, {SCRIPTS},
hook AS (SELECT run_id, change_id, package, from_ver, to_ver, side, arg_min(hook, {SHAPE_RANK}) AS hook
  FROM scripts WHERE hook IN {_in(V.SELF_PUBLISH_HOOKS)} GROUP BY ALL),
ex AS (SELECT change_id, side, arg_min(path, ord) AS path FROM facts WHERE cap = 'exec_module' GROUP BY ALL),
wr AS (SELECT change_id, side, arg_min(path, ord) AS path, arg_min(key, ord) AS target FROM facts
  WHERE cap = 'fs_write' AND (key = 'package.json' OR key LIKE '%/package.json') GROUP BY ALL),
shape AS (SELECT h.*, ex.path AS xpath, wr.path AS wpath, wr.target FROM hook h JOIN ex USING (change_id, side) JOIN wr USING (change_id, side)),
hit AS (SELECT n.*, EXISTS (SELECT 1 FROM hook b WHERE b.change_id = n.change_id AND b.side = 'old') AS had FROM shape n WHERE n.side = 'new'
  AND NOT EXISTS (SELECT 1 FROM shape p WHERE p.side = 'old' AND p.change_id = n.change_id AND p.hook = n.hook AND p.target = n.target))
""" + _flat_select("'install.self-publish-shape'", "CASE WHEN had THEN 'WARN' ELSE 'BLOCK' END", "CASE WHEN had THEN 'medium' ELSE 'high' END",
                   "wpath", "1", "'hook=' || hook || ', exec-in=' || xpath || ', writes=' || target", "hit")
ORACLE["image_read_exec"] = f"""WITH {FACTS},
img AS (SELECT 'r' || (p_partkey % 50 % 7) AS run_id, 's' || (p_partkey % 50) AS change_id, 'pkg-' || (p_partkey % 50) AS package,
    CASE WHEN p_partkey % 50 % 4 <> 0 THEN '1.0.0' END AS from_ver, '2.0.0' AS to_ver,
    CASE WHEN p_partkey % 50 % 4 <> 0 AND p_partkey % 3 = 0 THEN 'old' ELSE 'new' END AS side,
    {_pick(['img/a', 'assets/a', 'a'], 'p_size % 3')} || (p_partkey % 7) || {_pick(['.png', '.jpg', '.txt'], 'p_partkey % 3')} AS path,
    md5((p_partkey % 3)::VARCHAR) AS sha, p_partkey AS ord FROM part),
pic AS (SELECT run_id, change_id, package, from_ver, to_ver, side, path, arg_max(sha, ord) AS sha FROM img
  WHERE regexp_matches(path, {_regex(V.IMAGE_SUFFIX)}) GROUP BY ALL),
changed AS (SELECT n.* FROM pic n LEFT JOIN pic p ON p.side = 'old' AND p.change_id = n.change_id AND p.path = n.path
  WHERE n.side = 'new' AND n.sha IS DISTINCT FROM p.sha),
sink AS (SELECT change_id, arg_min(path, ord) AS sink FROM facts WHERE side = 'new' AND cap = 'dynamic_code'
  AND kind IN ('eval','new-function','vm') GROUP BY change_id),
reads AS (SELECT change_id, key, arg_min(path, ord) AS reader, min(ord) AS ord FROM facts WHERE side = 'new' AND cap = 'fs_read'
  AND regexp_matches(key, {_regex(V.IMAGE_SUFFIX)}) GROUP BY ALL),
loose AS (SELECT change_id, regexp_extract(key, '[^/]*$') AS bare, arg_min(reader, ord) AS reader FROM reads GROUP BY ALL),
hit AS (SELECT c.*, s.sink, COALESCE(r.reader, l.reader) AS reader FROM changed c JOIN sink s USING (change_id)
  LEFT JOIN reads r ON r.change_id = c.change_id AND r.key = c.path
  LEFT JOIN loose l ON l.change_id = c.change_id AND l.bare = regexp_extract(c.path, '[^/]*$'))
""" + _flat_select("'obf.image-decode-exec'", "'WARN'", "'medium'", "reader", "1",
                   "'fsRead(\"' || path || '\") + dynamic-code sink in ' || sink", "hit", "WHERE reader IS NOT NULL")
ORACLE["mangled_ids"] = f"""WITH {FACTS},
ids AS (SELECT run_id, change_id, package, from_ver, to_ver, side, path, ord, unnest(regexp_extract_all(snippet, {_regex(V.MANGLED_ID)})) AS id
  FROM facts WHERE cap IN ('dynamic_code','env','suspicious_literal') AND regexp_matches(path, {_regex(V.JS_SOURCE)})),
now AS (SELECT run_id, change_id, package, from_ver, to_ver, path, id, min(ord) AS first FROM ids WHERE side = 'new' GROUP BY ALL),
tagged AS (SELECT n.*, EXISTS (SELECT 1 FROM ids o WHERE o.side = 'old' AND o.change_id = n.change_id AND o.path = n.path AND o.id = n.id) AS known FROM now n),
g AS (SELECT run_id, change_id, package, from_ver, to_ver, path, count(*) AS a, count(*) FILTER (WHERE NOT known) AS b,
    list(id ORDER BY first, id) FILTER (WHERE NOT known) AS fresh FROM tagged GROUP BY ALL)
""" + _flat_select("'obf.js-mangler-signature'", "'WARN'", "CASE WHEN from_ver IS NULL THEN 'medium' ELSE 'high' END", "path", "1",
                   "'mangled identifiers: ' || array_to_string(fresh[1:5], ', ')", "g", "WHERE a >= 3 AND b >= 3")
ORACLE["homoglyph"] = f"""WITH {FACTS},
s AS (SELECT *, CASE WHEN cap = 'url' THEN key ELSE snippet END AS sample,
    CASE cap WHEN 'url' THEN 1 WHEN 'suspicious_literal' THEN 2 WHEN 'dynamic_code' THEN 3 WHEN 'env' THEN 4 END AS rank FROM facts
  WHERE cap IN ('url','suspicious_literal','dynamic_code','env') AND regexp_matches(path, {_regex(V.JS_SOURCE)})),
c AS (SELECT * FROM s WHERE regexp_matches(sample, {_regex(f'[A-Za-z]{V.CONFUSABLE_CLASS}|{V.CONFUSABLE_CLASS}[A-Za-z]')})),
n AS (SELECT run_id, change_id, package, from_ver, to_ver, path, arg_min(sample, (rank, ord)) AS sample FROM c x WHERE side = 'new'
  AND NOT EXISTS (SELECT 1 FROM c y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.path = x.path) GROUP BY ALL)
""" + _flat_select("'obf.unicode-homoglyph-boundary'", "'WARN'", "'medium'", "path", "1", "'homoglyph sample: ' || sample", "n")
ORACLE["wasm_unparseable"] = """WITH a AS (SELECT 'r' AS run_id, 'w-' || p_brand AS change_id, 'w-' || p_brand AS package, '1' AS from_ver, '2' AS to_ver,
    CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE 'new' END AS side, 'w' || p_size || '.wasm' AS path, 'bad section ' || (p_partkey % 3) AS why
  FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 < 2),
n AS (SELECT run_id, change_id, package, from_ver, to_ver, path, min(why) AS why FROM a x WHERE side = 'new' AND NOT EXISTS (
  SELECT 1 FROM a y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.path = x.path) GROUP BY ALL)
""" + _flat_select("'wasm.unparseable'", "'WARN'", "'medium'", "path", "1", "'parse error: ' || why", "n")

# --- text measures ----------------------------------------------------------------------------------
MINIFIED = """(length(text) >= 200 AND ((list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 400
  AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 60)) / len(string_split(text, chr(10))) < 0.3)
  OR (length(text) / len(string_split(text, chr(10))) > 120
  AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 60)) / len(string_split(text, chr(10))) < 0.1)))"""
ENTROPY_ROWS = """octets AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
byte_counts AS (SELECT doc_id, b, count(*) AS c FROM octets GROUP BY doc_id, b),
entropies AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM byte_counts GROUP BY doc_id)"""
ORACLE["entropy_by_file"] = f"""WITH {ENTROPY_ROWS} SELECT d.doc_id, round(COALESCE(e.entropy, 0), 6) AS entropy
  FROM documents d LEFT JOIN entropies e USING (doc_id)"""
ORACLE["minified_files"] = f"SELECT doc_id FROM documents WHERE {MINIFIED}"
ORACLE["printable_share"] = r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x20-\x7e\t\n\r]', '', 'g')) / length(text), 6) AS share FROM documents"""
JS_URL_SQL = "'" + (r"(?i)\b(https?://[^\s''" + '"' + r"`<>]+|(?:[a-z0-9-]+\.)+(?:" + "|".join(V.AMBIGUOUS_TLDS) + r")[:/?#][^\s''" + '"' + r"`<>]*"
    r"|(?:[a-z0-9-]+\.)+(?:" + "|".join(V.PLAIN_TLDS) + r"))\b") + "'"
ORACLE["text_urls"] = f"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, {JS_URL_SQL}, 1)) AS found FROM pages)
  SELECT page_id, found, count(*) AS n FROM u GROUP BY page_id, found"""
ORACLE["live_hosts"] = rf"""WITH t AS (SELECT page_id AS doc_id, regexp_replace(url, '\.example\.', '.sample.', 'g') || ' ' || html AS text FROM pages),
h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text,
    '(?i)(?:https?|ftps?|wss?|file|smtps?|imaps?|pop3s?|ldaps?|ssh|git)://((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,24}})\b', 1)
  || regexp_extract_all(text, '\b((?:\d{{1,3}}\.){{3}}\d{{1,3}})\b', 1))) AS host FROM t)
SELECT doc_id, lower(host) AS host FROM h WHERE CASE WHEN regexp_matches(host, '^[\d.]+$') THEN NOT regexp_matches(host, '^(127|0)\.')
  ELSE lower(host) NOT IN {_in(V.RESERVED_DOMAINS)} AND regexp_extract(lower(host), '[^.]*$') NOT IN {_in(V.RESERVED_TLDS)} END"""
FILES = f"""{ENTROPY_ROWS},
file_base AS (SELECT *, doc_id // 40 AS unit, (doc_id // 20) % 2 = 0 AS half, source IN ('src0','src5','src10','src15') AS is_added FROM documents),
file_rows AS (SELECT doc_id, source, unit, half AND unit % 5 <> 1 AND NOT is_added AS is_old, is_added,
    CASE WHEN half THEN unit % 5 <> 1 AND NOT is_added ELSE unit % 3 <> 2 END AS placed,
    {MINIFIED} AS minified, len(regexp_extract_all(text, '[0-9a-f]{{40}}')) AS suspicious FROM file_base),
files AS (SELECT 'docs' AS run_id, source AS change_id, source AS package, CASE WHEN NOT is_added THEN '1' END AS from_ver, '2' AS to_ver, is_old,
    CASE WHEN NOT placed THEN 'extra/f' || doc_id || '.js' ELSE CASE WHEN unit % 4 = 0 THEN 'dist/f' ELSE 'src/f' END || unit || '.js' END AS path, minified, suspicious, COALESCE(entropy, 0) AS entropy, unit
  FROM file_rows LEFT JOIN entropies USING (doc_id)),
n AS (SELECT f.*, p.path IS NOT NULL AS paired, p.entropy AS e0, p.minified AS m0, p.suspicious AS s0,
    regexp_matches(f.path, {_regex(V.BUILD_DIR)}) AS build, (f.path LIKE 'dist/%' AND (f.change_id, f.unit) IN (SELECT (source, doc_id // 40) FROM documents WHERE lang = 'en')) AS expected
  FROM files f LEFT JOIN files p ON p.is_old AND p.change_id = f.change_id AND p.path = f.path WHERE NOT f.is_old)"""
OBF_CONF = "CASE WHEN expected OR from_ver IS NULL THEN 'low' ELSE 'medium' END"
ORACLE["entropy_jump"] = f"""WITH {FILES}
SELECT run_id, change_id, 'obf.entropy-jump' AS detector, package, from_ver, to_ver, {DIRECTION} AS direction,
  CASE WHEN expected THEN 'INFO' ELSE 'WARN' END AS severity, {OBF_CONF} AS confidence, path AS file, 1::INTEGER AS line FROM n
WHERE paired AND ((entropy - e0 > 1.5 AND NOT (build AND e0 >= 4.5)) OR (minified AND NOT m0) OR (s0 = 0 AND suspicious > 0))"""
ORACLE["new_obfuscated_file"] = f"WITH {FILES} " + _flat_select(
    "'obf.new-obfuscated-file'", "CASE WHEN expected THEN 'INFO' ELSE 'WARN' END", OBF_CONF, "path", "1",
    "concat_ws('; ', CASE WHEN minified THEN 'shipped minified' END, CASE WHEN suspicious > 0 THEN suspicious || ' opaque literal(s)' END)",
    "n", "WHERE NOT paired AND (minified OR suspicious > 0)")

# --- manifests -----------------------------------------------------------------------------------------
DEPS = f"""
deps AS (
  SELECT 'r' AS run_id, 'c' || o_custkey AS change_id, 'cust-' || o_custkey AS package, CASE WHEN o_custkey % 5 <> 0 THEN '1.0.0' END AS from_ver,
    '1.1.0' AS to_ver, CASE WHEN o_custkey % 5 <> 0 AND month(o_orderdate) % 2 = 0 THEN 'old' ELSE 'new' END AS side,
    o_orderkey % 4 AS bucket, 'dep-' || (o_orderkey % 12) AS name,
    CASE WHEN o_orderkey % 7 = 0 THEN 'http://mirror' || (o_orderkey % 4) || '.example/a.tgz'
      WHEN o_orderkey % 7 = 1 THEN 'https://' || {_pick(['registry.npmjs.org', 'cdn.example:8443', 'files.example'], 'o_orderkey % 3')} || '/a-' || (o_orderkey % 4) || '.tgz'
      ELSE '^1.' || (o_orderkey % 9) || '.0' END AS spec, o_orderkey AS ord FROM orders)
"""
ORACLE["new_direct_dep"] = f"""WITH {DEPS},
n AS (SELECT run_id, change_id, package, from_ver, to_ver, name, arg_max(spec, ord) AS spec FROM deps x WHERE bucket = 0 AND side = 'new'
  AND from_ver IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deps y WHERE y.bucket = 0 AND y.side = 'old' AND y.change_id = x.change_id
  AND y.name = x.name) GROUP BY ALL)
""" + _flat_select("'deps.new-direct-dep'", "'INFO'", "'medium'", "'package.json'", "1", "'\"' || name || '\": \"' || spec || '\"'", "n")
ORACLE["dep_spec_class"] = f"""WITH {DEPS},
m AS (SELECT run_id, change_id, package, from_ver, to_ver, side, name, arg_max(spec, (bucket, ord)) AS spec FROM deps WHERE bucket < 3 GROUP BY ALL),
n AS (SELECT a.*, regexp_extract(a.spec, '^https?://([^/]*)', 1) AS host FROM m a LEFT JOIN m b ON b.side = 'old' AND b.change_id = a.change_id
  AND b.name = a.name WHERE a.side = 'new' AND a.spec IS DISTINCT FROM b.spec)
""" + _flat_select("'manifest-deps.http-resolved-url'", "CASE WHEN spec LIKE 'http:%' THEN 'BLOCK' ELSE 'WARN' END",
                   "CASE WHEN spec LIKE 'http:%' THEN 'high' ELSE 'medium' END", "'package.json'", "1", "'\"' || name || '\": \"' || spec || '\"'",
                   "n", f"WHERE spec LIKE 'http://%' OR (spec LIKE 'https://%' AND host NOT IN {_in(V.REGISTRY_HOSTS)})")
EMAILS = """
emails AS (
  SELECT 'r' AS run_id, 'n' || c_nationkey || '-' || (floor(abs(c_acctbal))::BIGINT % 20) AS change_id,
    'n' || c_nationkey || '-' || (floor(abs(c_acctbal))::BIGINT % 20) AS package, CASE WHEN c_nationkey % 6 <> 0 THEN '1.0.0' END AS from_ver,
    '1.1.0' AS to_ver, CASE WHEN c_nationkey % 6 <> 0 AND c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS side,
    'u' || (c_custkey % 11) || '@' || lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '.sub.example' ELSE '.example' END AS email
  FROM customer)
"""
ORACLE["maintainer_change"] = f"""WITH {EMAILS},
trust AS (SELECT DISTINCT 'n' || s_nationkey || '-' || (s_suppkey % 20) AS package, {_pick(
    ['@building.example', 'u3', '@machinery.example', 'u1@household.example', '@automobile.example', '@furniture.example', 'u7'], 's_suppkey % 7')} AS anchor FROM supplier),
e AS (SELECT run_id, change_id, package, from_ver, to_ver, email, bool_or(side = 'old') AS was, bool_or(side = 'new') AS now
  FROM emails WHERE from_ver IS NOT NULL GROUP BY ALL),
j AS (SELECT e.*, EXISTS (SELECT 1 FROM trust t WHERE t.package = e.package) AS listed, EXISTS (SELECT 1 FROM trust t WHERE t.package = e.package
    AND length(t.anchor) >= 3 AND CASE WHEN t.anchor LIKE '@%' THEN split_part(email, '@', 2) = t.anchor[2:] OR split_part(email, '@', 2) LIKE '%.' || t.anchor[2:]
      WHEN t.anchor LIKE '%@%' THEN email = t.anchor ELSE split_part(email, '@', 1) = t.anchor END) AS trusted FROM e),
g AS (SELECT run_id, change_id, package, from_ver, to_ver, bool_or(listed) AS listed, count(*) FILTER (WHERE was) AS n_old, count(*) FILTER (WHERE now) AS n_new,
    count(*) FILTER (WHERE was AND NOT now) AS gone, count(*) FILTER (WHERE now AND NOT was) AS added,
    count(*) FILTER (WHERE now AND NOT was AND NOT trusted) AS unknown, bool_and(trusted) FILTER (WHERE was) AS told, bool_and(trusted) FILTER (WHERE now) AS tnew,
    bool_or(trusted) FILTER (WHERE now) AS tany, array_to_string(list(email ORDER BY email) FILTER (WHERE was), ', ') AS old_list,
    array_to_string(list(email ORDER BY email) FILTER (WHERE now), ', ') AS new_list FROM j GROUP BY ALL),
v AS (SELECT *, CASE WHEN n_new = 0 THEN CASE WHEN told THEN 'BLOCK high' ELSE 'WARN medium' END WHEN n_old = 0 THEN 'WARN medium'
    WHEN NOT listed THEN 'WARN medium' WHEN told AND NOT tany THEN 'BLOCK high' WHEN unknown > 0 THEN 'WARN medium'
    WHEN told AND tnew THEN 'INFO high' WHEN tnew THEN 'INFO medium' ELSE 'WARN medium' END AS verdict FROM g WHERE gone > 0 OR added > 0)
""" + _flat_select("'meta.maintainer-change'", "split_part(verdict, ' ', 1)", "split_part(verdict, ' ', 2)", "'package.json'", "1",
                   "'maintainers: [' || COALESCE(old_list, '') || '] → [' || COALESCE(new_list, '') || ']'", "v")
ORACLE["disposable_domain"] = f"""WITH {EMAILS},
dom AS (SELECT DISTINCT lower(c_mktsegment) || '.sub.example' AS domain FROM customer WHERE c_acctbal < 0),
f AS (SELECT DISTINCT run_id, change_id, package, from_ver, to_ver, email FROM emails x WHERE side = 'new' AND split_part(email, '@', 2) IN (SELECT domain FROM dom)
  AND NOT EXISTS (SELECT 1 FROM emails y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.email = x.email)),
g AS (SELECT run_id, change_id, package, from_ver, to_ver, array_to_string(list(email ORDER BY email), ', ') AS listed FROM f GROUP BY ALL)
""" + _flat_select("'meta.disposable-author-domain'", "CASE WHEN from_ver IS NULL THEN 'BLOCK' ELSE 'WARN' END",
                   "CASE WHEN from_ver IS NULL THEN 'high' ELSE 'medium' END", "'package.json'", "1", "'disposable-domain email(s): ' || listed", "g")
BUNDLED = f"""
bundled AS (SELECT 'r' AS run_id, 'b' || l_suppkey || '-' || (l_partkey % 10) AS change_id, 'b' || l_suppkey || '-' || (l_partkey % 10) AS package,
    CASE WHEN l_partkey % 10 <> 0 THEN '1.0.0' END AS from_ver, '1.1.0' AS to_ver,
    CASE WHEN l_partkey % 10 <> 0 AND l_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS side, 'inner' || ((l_orderkey + l_linenumber) % 40) AS name,
    {_pick(T.HOOKS, 'l_orderkey % 8')} AS hook, 'node x' || l_linenumber || '.js' AS body FROM lineitem)
"""
ORACLE["bundled_added"] = f"""WITH {BUNDLED},
f AS (SELECT DISTINCT run_id, change_id, package, from_ver, to_ver FROM bundled x WHERE side = 'new' AND NOT EXISTS (
  SELECT 1 FROM bundled y WHERE y.side = 'old' AND y.change_id = x.change_id AND y.name = x.name))
SELECT run_id, change_id, 'deps.bundled-dependency-added' AS detector, package, from_ver, to_ver, {DIRECTION} AS direction, 'WARN' AS severity,
  'high' AS confidence, 'package.json' AS file, 1::INTEGER AS line FROM f"""
ORACLE["bundled_hooks"] = f"""WITH {BUNDLED} SELECT change_id, 'node_modules/' || name || '/package.json' AS file, hook || ': ' || body AS snippet,
  {DIRECTION} AS direction, 'BLOCK' AS severity, count(*) AS n FROM bundled WHERE side = 'new' AND hook IN {_in(V.BUNDLED_HOOKS)} GROUP BY ALL"""

# --- names -------------------------------------------------------------------------------------------
POPULAR = """base AS (SELECT p_partkey AS k, replace(lower(p_name), ' ', '-') || '-' || lower(p_type) AS word, lower(p_type) AS kind,
    lower(split_part(p_name, ' ', 1)) AS w1, lower(split_part(p_name, ' ', 2)) AS w2 FROM part),
popular AS (SELECT word AS name, min(k) AS ord FROM base GROUP BY word)"""
ORACLE["typosquat"] = f"""WITH {POPULAR},
cand AS (SELECT k, substr(word, 1, k % length(word)) || substr(word, k % length(word) + 2) AS name FROM base),
pairs AS (SELECT c.name, p.name AS target, p.ord, damerau_levenshtein(c.name, p.name) AS d FROM (SELECT DISTINCT name FROM cand) c, popular p
  WHERE c.name NOT IN (SELECT name FROM popular) AND abs(length(c.name) - length(p.name)) <= 2),
best AS (SELECT name, arg_min(target, (d, ord)) AS target, min(d) AS d FROM pairs WHERE d <= 2 GROUP BY name),
n AS (SELECT 'r' AS run_id, 'p' || k AS change_id, name AS package, NULL::VARCHAR AS from_ver, '1.0.0' AS to_ver, target, d FROM cand JOIN best USING (name))
""" + _flat_select("'deps.typosquat-candidate'", "'WARN'", "CASE WHEN d <= 1 THEN 'high' ELSE 'medium' END", "'package.json'", "1",
                   "'\"' || package || '\" (distance ' || d || ' from \"' || target || '\")'", "n")
ORACLE["hyphen_permutation"] = f"""WITH {POPULAR},
cand AS (SELECT k, CASE k % 4 WHEN 0 THEN kind || '-' || w2 || '-' || w1 WHEN 1 THEN w1 || '-' || w2 || '-' || kind || '-kit' WHEN 2 THEN w1 || '-' || w2
    ELSE w2 || '-plus-' || w1 END AS name FROM base),
t AS (SELECT name, list_sort(list_distinct(string_split(name, '-'))) AS ours FROM (SELECT DISTINCT name FROM cand) WHERE name NOT IN (SELECT name FROM popular)),
p AS (SELECT name AS target, ord, list_sort(list_distinct(string_split(name, '-'))) AS theirs FROM popular),
x AS (SELECT name, target, ord, len(list_intersect(ours, theirs)) AS c, len(ours) AS a, len(theirs) AS b FROM t, p WHERE len(ours) >= 2 AND len(theirs) >= 2),
s AS (SELECT *, CASE WHEN a = c AND b = c THEN 'reorder' WHEN a = c + 1 AND b = c THEN 'add-token' WHEN a = c AND b = c + 1 THEN 'drop-token' END AS shape
  FROM x WHERE c >= 2),
best AS (SELECT name, arg_min(target, ((shape <> 'reorder')::INT, ord)) AS target, arg_min(shape, ((shape <> 'reorder')::INT, ord)) AS shape FROM s
  WHERE shape IS NOT NULL GROUP BY name),
n AS (SELECT 'r' AS run_id, 'p' || k AS change_id, name AS package, NULL::VARCHAR AS from_ver, '1.0.0' AS to_ver, target, shape FROM cand JOIN best USING (name))
""" + _flat_select("'typo.hyphen-permutation'", "CASE shape WHEN 'reorder' THEN 'BLOCK' ELSE 'WARN' END", "CASE shape WHEN 'reorder' THEN 'high' ELSE 'medium' END",
                   "'package.json'", "1", "'\"' || package || '\" is a hyphen-token ' || shape || ' of \"' || target || '\"'", "n")
ORACLE["canonical_names"] = """SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '__') || '.-' || p_brand), '[-_.]+', '-', 'g') AS name FROM part"""
ORACLE["package_specs"] = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '@' || replace(p_brand, '#', '') || '/' ELSE '' END || split_part(p_name, ' ', 1) AS name,
  CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_size ELSE 'latest' END AS version FROM part"""

# --- escalation ------------------------------------------------------------------------------------------
FINDINGS = f"""
finding_base AS (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events),
finding_pick AS (SELECT *, {_pick([d for d, _ in T.DETECTORS], '(event_id * 7 + k) % 16')} AS detector,
    {_pick([c for _, c in T.DETECTORS], '(event_id * 7 + k) % 16')} AS category, user_id || '-' || (event_id % 29) AS unit FROM finding_base),
findings AS (SELECT event_id, event_type, 'r' || (user_id % 5) AS run_id, 'c' || unit AS change_id, detector, category, 'u' || unit AS package,
    CASE WHEN event_type <> 'signup' THEN '1.0.' || (k % 7) END AS from_ver, '1.' || (k % 5) || '.' || (k % 9) AS to_ver,
    CASE event_type WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'absolute' ELSE 'changed' END AS direction,
    CASE WHEN k % 10 < 1 THEN 'BLOCK' WHEN k % 10 < 7 THEN 'WARN' ELSE 'INFO' END AS severity,
    {_pick(['high', 'medium', 'low'], 'k % 3')} AS confidence,
    CASE WHEN category = 'INSTALL' THEN 'Lifecycle script "' || {_pick(['postinstall', 'test'], 'k % 2')} || '" was added' ELSE 'm' || k END AS message,
    'lib/f' || (event_id % 13) || '.js' AS file, (k + 1)::INTEGER AS evidence_line,
    CASE category WHEN 'NET' THEN 'call https://h' || k || '.example/x now' WHEN 'ENV' THEN 'process.env.' || {_pick(['NPM_TOKEN', 'HOME', 'GH_TOKEN'], 'k % 3')}
      WHEN 'META' THEN 'maintainers: [a@x.example] → [b' || k || '@y.example]' ELSE 's' || k END AS snippet,
    CASE WHEN category = 'CODE' THEN {_pick(['eval', 'new-function', 'vm', 'dynamic-import'], 'k % 4')} END AS code_kind FROM finding_pick)
"""
ESCALATION = FINDINGS + """,
net AS (SELECT DISTINCT change_id FROM findings WHERE event_type = 'click'),
risky AS (SELECT DISTINCT package FROM findings WHERE category IN ('NET','INSTALL','EXEC','ENV','FS') OR (category = 'CODE' AND code_kind IN ('eval','new-function'))),
s1 AS (SELECT *, CASE WHEN category = 'OBF' AND severity = 'WARN' AND package IN (SELECT package FROM risky) THEN 'BLOCK' ELSE severity END AS sev1 FROM findings),
blocked AS (SELECT DISTINCT package FROM s1 WHERE sev1 = 'BLOCK' AND category IN ('NET','INSTALL','EXEC','ENV','FS','CODE','OBF')),
multi AS (SELECT package FROM s1 WHERE sev1 = 'WARN' GROUP BY package HAVING count(DISTINCT category) >= 2),
s2 AS (SELECT *, CASE WHEN detector = 'deps.typosquat-candidate' AND sev1 = 'WARN' AND (package IN (SELECT package FROM blocked)
    OR package IN (SELECT package FROM multi)) THEN 'BLOCK' ELSE sev1 END AS sev2 FROM s1),
warns AS (SELECT change_id, package, count(*) AS n_warn, count(DISTINCT category) AS n_kind, list(DISTINCT category) AS cats,
    count(*) FILTER (WHERE category = 'CODE' AND code_kind IN ('eval','new-function')) AS risky_code,
    array_to_string(list_sort(list(DISTINCT detector)), ',') AS detectors FROM s2 WHERE sev2 = 'WARN' GROUP BY change_id, package),
lifted AS (SELECT * FROM warns w WHERE (n_warn >= 3 AND n_kind >= 2)
  OR (n_warn >= 2 AND ((list_has_all(cats, ['ENV','EXEC']) OR list_has_all(cats, ['ENV','INSTALL']) OR list_has_all(cats, ['EXEC','INSTALL']))
    OR (change_id IN (SELECT change_id FROM net) AND (list_has_all(cats, ['NET','ENV']) OR list_has_all(cats, ['NET','EXEC']) OR list_has_all(cats, ['NET','INSTALL'])))))
  OR (n_warn >= 3 AND cats = ['OBF']) OR (risky_code >= 3 AND cats = ['CODE']))
"""
ORACLE["escalation"] = f"""WITH {ESCALATION} SELECT event_id, CASE WHEN sev2 = 'WARN' AND package IN (SELECT package FROM lifted) THEN 'BLOCK' ELSE sev2 END AS severity FROM s2"""
ORACLE["obf_escalation"] = f"WITH {ESCALATION} SELECT DISTINCT change_id, package FROM s1 WHERE sev1 <> severity"
ORACLE["typo_escalation"] = f"WITH {ESCALATION} SELECT DISTINCT change_id, package FROM s2 WHERE sev2 <> sev1"
ORACLE["compound_escalation"] = f"WITH {ESCALATION} SELECT change_id, package, n_warn, n_kind, detectors FROM lifted"
ORACLE["first_install_fallback"] = f"""WITH {FINDINGS},
g AS (SELECT run_id, change_id, package, NULL::VARCHAR AS from_ver, '1.0.0' AS to_ver, count(*) FILTER (WHERE detector = 'env.token-harvest') AS env FROM findings
  WHERE direction = 'added' GROUP BY ALL HAVING count(*) FILTER (WHERE detector IN ('net.new-endpoint','net.new-module')) > 0 AND env >= 3)
""" + _flat_select("'deps.first-version-cluster'", "'BLOCK'", "'high'", "'package.json'", "1",
                   "'first-version-with-cluster: NET + ' || env || ' sensitive env reads'", "g")
_RANGES = {  # (package, ghsa): predicate over v = major * 1000000 + minor * 1000 + patch
    "GHSA-fh58-9fw3-vf2v": ("ua-parser-js", "{v} IN (7029,8000,1000000)"),
    "GHSA-mh6f-8j2x-4483": ("coa", "({v} >= 2000003 AND {v} <= 2001003)"),
    "GHSA-g2q5-5433-rhrf": ("rc", "{v} IN (1002009,1003009,2003009)"),
    "GHSA-mh63-6h87-95cp": ("event-stream", "{v} = 3003006"),
    "GHSA-jf85-cpcp-j695": ("colors", "({v} = 1004001 OR {v} >= 1004044)"),
    "GHSA-8v38-pw62-9cw2": ("node-ipc", "(({v} >= 9002002 AND {v} < 10000000) OR ({v} >= 10001001 AND {v} <= 10001002) OR {v} = 11000000)"),
    "GHSA-5qgm-9j92-h5g5": ("eslint-scope", "{v} IN (3007002,4000001)"),
    "GHSA-jj35-jhw9-vp4q": ("@solana/web3.js", "({v} >= 1095005 AND {v} <= 1095007)"),
    "GHSA-cwfw-4gq5-mrqx": ("@lottiefiles/lottie-player", "({v} >= 2000005 AND {v} <= 2000007)"),
    "GHSA-3xgq-45jj-v275": ("tough-cookie", "{v} < 4001003"),
    "GHSA-x2pg-mjhr-2m5x": ("axios", "({v} < 28000 OR ({v} >= 1000000 AND {v} < 1006000))"),
}
_NEAR = [(0, d, None) for d in (-3, -2, -1, 1, 2, 3)] + [(d, 0, 0) for d in (-1, 1)]


def _advisory(relation: str) -> str:
    parts = []
    for ghsa, (package, test) in _RANGES.items():
        exact = test.format(v="(a * 1000000 + b * 1000 + c)")
        near = " OR ".join(
            f"(b + {db} >= 0 AND {'c + ' + str(dc) if fixed is None else '0'} >= 0 AND "
            + test.format(v=f"(a * 1000000 + (b + {db}) * 1000 + {'c + ' + str(dc) if fixed is None else '0'})") + ")"
            for db, dc, fixed in _NEAR
        )
        where = exact if relation == "affected" else f"NOT ({exact}) AND ({near})"
        parts.append(f"SELECT package, version, '{ghsa}' AS ghsa FROM v WHERE package = '{package}' AND ({where})")
    names = [a[2] for a in V.ADVISORIES]
    return f"""WITH v AS (SELECT DISTINCT {_pick(names, f'o_orderkey % {len(names)}')} AS package, (o_orderkey % 12)::INT AS a, (o_custkey % 7)::INT AS b,
      (month(o_orderdate) % 9)::INT AS c, a || '.' || b || '.' || c AS version FROM orders) """ + " UNION ALL ".join(parts)


ORACLE["advisory_match"] = _advisory("affected")
ORACLE["adjacent_advisory"] = _advisory("adjacent")
ORACLE["technique_tags"] = f"WITH {FINDINGS} SELECT event_id, CASE detector " + " ".join(
    f"WHEN '{d}' THEN '{','.join(t)}'" for d, t in V.TECHNIQUE_TAGS.items()) + " ELSE '' END AS tags FROM findings"

# --- verdicts, scores, policy --------------------------------------------------------------------------
ORACLE["verdict"] = f"WITH {FINDINGS} SELECT run_id, change_id, {LABEL.format(f'min({RANK})')} AS verdict FROM findings GROUP BY run_id, change_id"
WEIGHT = """(CASE severity WHEN 'BLOCK' THEN 5 WHEN 'WARN' THEN 2 ELSE 0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.5 END
  * CASE direction WHEN 'changed' THEN 0.8 WHEN 'removed' THEN 0.3 ELSE 1.0 END)::DECIMAL(18,4)"""
ORACLE["risk_score"] = f"WITH {FINDINGS} SELECT change_id, (floor(least(sum({WEIGHT}), 10) * 10 + 0.5) / 10)::DOUBLE AS risk_score FROM findings GROUP BY change_id"
ORACLE["severity_rollup"] = f"""WITH {FINDINGS} SELECT run_id, package, count(*) FILTER (WHERE severity = 'BLOCK') AS block,
  count(*) FILTER (WHERE severity = 'WARN') AS warn, count(*) FILTER (WHERE severity = 'INFO') AS info, count(*) AS total,
  count(DISTINCT category) AS categories FROM findings GROUP BY run_id, package"""
ORACLE["exit_codes"] = f"""WITH {FINDINGS},
forced AS (SELECT DISTINCT {_pick([d for d, _ in T.DETECTORS], 'n_nationkey % 16')} AS detector FROM nation WHERE n_regionkey = 2)
SELECT change_id, CASE WHEN min({RANK}) = 0 OR bool_or(detector IN (SELECT detector FROM forced)) THEN 2 WHEN min({RANK}) = 1 THEN 1 ELSE 0 END::INTEGER AS code
FROM findings GROUP BY change_id"""
ORACLE["finding_order_topk"] = f"WITH {FINDINGS} SELECT event_id, severity, package, detector FROM findings ORDER BY {RANK}, package, detector, file, event_id LIMIT 100"
ORACLE["config_apply"] = f"""WITH {FINDINGS},
allow AS (SELECT 'u' || s_suppkey || '-' || (s_suppkey % 29) AS package, {_pick(['NET', 'ENV', 'META', 'INSTALL'], 's_suppkey % 4')} AS category FROM supplier),
ign AS (SELECT 'u' || s_suppkey || '-' || (s_suppkey % 7) AS package FROM supplier WHERE s_acctbal < 1000),
ignp AS (SELECT 'u' || s_suppkey || '-' || (s_suppkey % 11) AS package FROM supplier WHERE s_acctbal > 6000),
tr AS (SELECT 'u' || s_suppkey || '-' || (s_suppkey % 13) AS package FROM supplier),
ov AS (SELECT {_pick([d for d, _ in T.DETECTORS], 'n_nationkey % 16')} AS detector, min({_pick(['BLOCK', 'WARN', 'INFO'], 'n_nationkey % 3')}) AS severity
  FROM nation WHERE n_regionkey = 1 GROUP BY 1),
f AS (SELECT *, detector IN ('integrity.hash-mismatch','analysis.failed') AS exempt FROM findings)
SELECT f.event_id, CASE WHEN f.detector = 'meta.maintainer-change' AND f.package IN (SELECT package FROM tr) AND contains(snippet, '@y.example') THEN 'INFO'
  WHEN NOT exempt AND ov.severity IS NOT NULL THEN ov.severity
  WHEN NOT exempt AND (f.package, f.category) IN (SELECT (package, category) FROM allow) THEN 'INFO' ELSE f.severity END AS severity
FROM f LEFT JOIN ov ON ov.detector = f.detector WHERE exempt OR (f.package NOT IN (SELECT package FROM ign)
  AND NOT (f.package IN (SELECT package FROM ignp) AND f.file LIKE 'lib/f1%'))"""
ORACLE["config_trust"] = """WITH c AS (SELECT c_custkey::VARCHAR AS run_id, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS cur,
  CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'other' END END AS base FROM customer),
d AS (SELECT *, cur IS NOT NULL AND (base IS NULL OR cur <> base) AS in_diff FROM c)
SELECT run_id, CASE WHEN cur IS NULL THEN 'default' WHEN in_diff THEN 'in-diff' ELSE 'baseline' END AS source, in_diff, in_diff AS blocked,
  CASE WHEN in_diff THEN 'BLOCK' END AS severity, CASE WHEN in_diff THEN CASE WHEN base IS NULL THEN 'added' ELSE 'changed' END END AS direction FROM d"""
ADMIT = FINDINGS + """,
adm AS (SELECT change_id, package, bool_or(detector = 'analysis.failed') AS failed, bool_or(severity = 'BLOCK') AS b, bool_or(severity = 'WARN') AS w,
    bool_or(severity = 'INFO') AS i FROM findings GROUP BY change_id, package),
decided AS (SELECT *, CASE WHEN failed OR b THEN 'block' WHEN w OR i THEN 'review' ELSE 'allow' END AS decision,
    CASE WHEN failed THEN 'analysis failed' WHEN b THEN 'blocking severity present: BLOCK'
      WHEN w OR i THEN 'review severity present: ' || concat_ws(', ', CASE WHEN i THEN 'INFO' END, CASE WHEN w THEN 'WARN' END)
      ELSE 'no finding matches the policy' END AS reason FROM adm)
"""
ORACLE["policy_decision"] = f"WITH {ADMIT} SELECT change_id, decision, reason FROM decided"
RECEIPT = """'{"artifactSha256":"' || sha256(package) || '","authenticity":"not-signed","decision":"' || decision || '","findingsHash":"' || findings_hash
  || '","integrity":"sha256-deterministic-unsigned","issuedAt":"2024-01-01T00:00:00.000Z","kind":"driftlens-admission-receipt","package":"' || package
  || '","packageVersion":"1.0.0","policyHash":"' || sha256('{"blockSeverities":["BLOCK"],"failClosed":true,"reviewSeverities":["INFO","WARN"]}')
  || '","projectHash":"' || sha256(change_id) || '","version":1}'"""
ORACLE["receipt_verify"] = f"WITH {ADMIT} SELECT package, (decision = 'allow' OR package NOT LIKE '%-7') AS valid FROM decided"
ORACLE["merge_gate"] = f"""WITH {FINDINGS},
g AS (SELECT run_id, package, bool_or(detector IN ('install.script-added','install.script-changed') AND message LIKE '%"postinstall" was added%') AS hook,
  bool_or(detector = 'env.token-harvest' AND regexp_matches(snippet, '\\b(NPM_TOKEN|GH_TOKEN)\\b')) AS secret,
  bool_or(detector = 'net.new-endpoint') AS endpoint FROM findings GROUP BY run_id, package)
SELECT run_id, package, CASE WHEN endpoint THEN 'install-time-secret-exfiltration' ELSE 'install-time-secret-harvest' END AS violation FROM g WHERE hook AND secret"""
ORACLE["explain_finding"] = f"WITH {FINDINGS} SELECT event_id, package, severity FROM findings WHERE detector = 'net.new-endpoint'"

# --- graph -------------------------------------------------------------------------------------------------
PATHS = """
nat AS (SELECT n_nationkey AS n, 'r' || n_regionkey AS r, '(root)>r' || n_regionkey || '>n' || n_nationkey AS path, [n_regionkey, n_nationkey]::BIGINT[] AS trail FROM nation),
sup AS (SELECT s_suppkey AS s, r, nat.path || '>s' || s_suppkey AS path, nat.trail || [s_suppkey] AS trail FROM supplier JOIN nat ON n = s_nationkey),
cus AS (SELECT c_custkey AS c, r, nat.path || '>c' || c_custkey AS path, nat.trail || [c_custkey] AS trail FROM customer JOIN nat ON n = c_nationkey),
ord AS (SELECT o_orderkey AS o, r, cus.path || '>o' || o_orderkey AS path, cus.trail || [o_orderkey] AS trail FROM orders JOIN cus ON c = o_custkey),
viasup AS (SELECT DISTINCT l_partkey AS p, r, sup.path || '>p' || l_partkey AS path, sup.trail || [l_partkey] AS trail FROM lineitem JOIN sup ON s = l_suppkey)
"""
ORACLE["provenance_paths"] = f"""WITH {PATHS},
ranked AS (SELECT 'p' || p AS key, path, row_number() OVER (PARTITION BY p ORDER BY trail) AS place FROM viasup),
viaord AS (SELECT DISTINCT l_partkey AS p, ord.path || '>p' || l_partkey AS path, ord.trail || [l_partkey] AS trail FROM lineitem JOIN ord ON o = l_orderkey
  WHERE l_partkey NOT IN (SELECT p FROM viasup)),
ranked2 AS (SELECT 'p' || p AS key, path, row_number() OVER (PARTITION BY p ORDER BY trail) AS place FROM viaord)
SELECT key, path, place::BIGINT AS place FROM ranked WHERE place <= 3 UNION ALL SELECT key, path, place FROM ranked2 WHERE place <= 3
UNION ALL SELECT 'r' || r_regionkey, '(root)>r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n, path, 1 FROM nat UNION ALL SELECT 's' || s, path, 1 FROM sup
UNION ALL SELECT 'c' || c, path, 1 FROM cus UNION ALL SELECT 'o' || o, path, 1 FROM ord"""
# the place is a binary number over the layers that are free, the last layer its lowest digit
ORACLE["diamond_paths"] = """WITH t AS (SELECT p_partkey AS k, p_partkey // 40 AS d, p_partkey % 40 // 2 AS layer, p_partkey % 2 AS c FROM part),
ends AS (SELECT d FROM t WHERE layer = 19 GROUP BY d),
targets AS (
  SELECT d, 'p' || k AS key, layer AS n, -1 AS around, 0 AS bit, '>p' || k AS tail FROM t
  UNION ALL SELECT d, 'x' || d, 20, -1, 0, '>x' || d FROM ends
  UNION ALL SELECT d, 'x' || d || '/p' || k, 20, layer, 1 - c, '>x' || d || '>p' || k FROM t SEMI JOIN ends USING (d)),
places AS (SELECT *, unnest(range(0, least(3, CAST(power(2, n - (around >= 0)::INT) AS INT)))) AS place FROM targets)
SELECT CAST(d AS VARCHAR) AS run_id, key, place + 1 AS place, 'app' || array_to_string(list_transform(range(0, n), lambda l: '>p' || (d * 40 + 2 * l +
  CASE WHEN l = around THEN bit ELSE (place // CAST(power(2, n - 1 - l - (around > l)::INT) AS INT)) % 2 END)), '') || tail AS path FROM places"""
CLOSURE = PATHS + """,
closure AS (SELECT DISTINCT * FROM (SELECT 'r' || r_regionkey AS direct, 'r' || r_regionkey AS name FROM region UNION ALL SELECT r, 'n' || n FROM nat
  UNION ALL SELECT r, 's' || s FROM sup UNION ALL SELECT r, 'c' || c FROM cus UNION ALL SELECT r, 'o' || o FROM ord
  UNION ALL SELECT r, 'p' || p FROM viasup UNION ALL SELECT r, 'p' || l_partkey FROM lineitem JOIN ord ON o = l_orderkey))
"""
ORACLE["subtree_closure"] = f"WITH {CLOSURE} SELECT direct, name FROM closure"
ORACLE["rollup_by_direct"] = f"""WITH {CLOSURE}, {FINDINGS},
per AS (SELECT 'c' || user_id AS name, {RANK} AS rank FROM (SELECT *, split_part(substr(package, 2), '-', 1) AS user_id FROM findings))
SELECT direct, {LABEL.format('COALESCE(min(rank), 3)')} AS max_severity, count(rank) AS count FROM closure LEFT JOIN per USING (name) GROUP BY direct"""

# --- studies, coverage, assurance ----------------------------------------------------------------------------
STUDY = FINDINGS + f""",
bump AS (SELECT package, package LIKE '%-3' AS failed, {LABEL.format(f'min({RANK})')} AS graded, count(*) AS n FROM findings GROUP BY package),
rows_ AS (SELECT package, failed, CASE WHEN failed THEN 'ERROR' ELSE graded END AS verdict, CASE WHEN failed THEN 0 ELSE n END AS finding_count FROM bump)
"""
ORACLE["study_npm"] = f"""WITH {STUDY} SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS failed,
  sum(finding_count)::BIGINT AS findings, count(*) FILTER (WHERE verdict = 'BLOCK') AS block, count(*) FILTER (WHERE verdict = 'WARN') AS warn,
  count(*) FILTER (WHERE verdict = 'INFO') AS info, count(*) FILTER (WHERE verdict = 'CLEAN') AS clean,
  round(sum(finding_count) / count(*) FILTER (WHERE NOT failed), 6) AS findings_per_bump FROM rows_"""
ORACLE["study_npm_detectors"] = f"""WITH {STUDY} SELECT detector, count(DISTINCT package) AS hits,
  round(count(DISTINCT package) / (SELECT count(*) FROM rows_ WHERE NOT failed), 6) AS rate FROM findings WHERE package NOT LIKE '%-3' GROUP BY detector"""
ORACLE["study_offenders"] = f"WITH {STUDY} SELECT package, verdict, finding_count FROM rows_ WHERE NOT failed ORDER BY finding_count DESC, package LIMIT 10"
ORACLE["study_pypi"] = f"""WITH {STUDY} SELECT count(*) FILTER (WHERE verdict = 'BLOCK') AS block, count(*) FILTER (WHERE verdict = 'WARN') AS warn,
  count(*) FILTER (WHERE verdict = 'INFO') AS info, count(*) FILTER (WHERE verdict = 'CLEAN') AS clean, count(*) FILTER (WHERE verdict = 'ERROR') AS error,
  round(count(*) FILTER (WHERE verdict = 'BLOCK') / count(*), 6) AS block_rate,
  round(count(*) FILTER (WHERE verdict IN ('BLOCK','WARN')) / count(*), 6) AS warn_or_block_rate FROM rows_"""
ORACLE["study_pypi_detectors"] = f"WITH {FINDINGS} SELECT detector, count(*) AS hits FROM findings GROUP BY detector"
ORACLE["coverage_gate"] = """WITH m AS (SELECT source, COALESCE(quality = 1, false) AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT COALESCE(source, '(overall)') AS class_id, count(*) FILTER (WHERE ok) AS covered, count(*) AS total,
  floor(count(*) FILTER (WHERE ok) * 100 / count(*))::BIGINT AS percent FROM m GROUP BY ROLLUP (source)"""
ORACLE["assurance_rates"] = """SELECT role, count(*) FILTER (WHERE length(text) % 3 = 0) AS passed, count(*) FILTER (WHERE length(text) % 3 = 1) AS failed,
  count(*) FILTER (WHERE length(text) % 3 = 2) AS skipped,
  round(avg(CASE length(text) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END), 6) AS rate FROM conversations GROUP BY role"""
ORACLE["ledger_by_class"] = f"""SELECT {_pick(['advisory-only', 'intentional-non-goal', 'real-gap', 'noise'], 'quality * 2 + toxic')} AS class,
  {_pick(['scanner-a', 'scanner-b', 'scanner-c'], 'doc_id % 3')} AS scanner, count(*) AS deltas FROM labels GROUP BY 1, 2"""
_CLASSES = ["net-egress", "secret-read", "env/secret-read", "fs-read", "obfuscation-decode"]
TURNS = f"""turns AS (SELECT conv_id AS case_id, turn, {_pick(['ok', 'crash', 'timeout', 'fail-safe', 'oom', 'ok'], 'length(text) % 6')} AS kind,
    {_pick(_CLASSES, 'length(text) % 5')} AS cls, {_pick(_CLASSES, 'conv_id % 5')} AS wanted FROM conversations)"""
ORACLE["oracle_fail_safe"] = f"""WITH {TURNS},
c AS (SELECT case_id, kind, CASE WHEN case_id % 4 = 0 THEN '*' WHEN case_id % 4 <> 1 THEN wanted END AS required FROM turns WHERE turn = 0)
SELECT case_id, kind, required, CASE WHEN kind = 'crash' THEN false WHEN kind IN ('timeout','oom') OR required IS NULL THEN true
  WHEN required = '*' AND kind = 'fail-safe' THEN true
  WHEN required = '*' THEN EXISTS (SELECT 1 FROM turns t WHERE t.case_id = c.case_id AND t.turn > 0)
  ELSE EXISTS (SELECT 1 FROM turns t WHERE t.case_id = c.case_id AND t.turn > 0 AND t.cls = c.required) END AS passed FROM c"""
ORACLE["finding_survives"] = f"""WITH {TURNS},
al AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{a}')" for c, names in V.CLASS_ALIASES.items() for a in names)}) v(wanted, accepted)),
v AS (SELECT case_id, wanted, max(CASE WHEN turn = 0 THEN kind END) AS k0, max(CASE WHEN turn = 1 THEN kind END) AS k1 FROM turns WHERE turn < 2 GROUP BY case_id, wanted),
h AS (SELECT DISTINCT t.case_id, t.turn % 2 AS side FROM turns t WHERE t.cls = t.wanted OR (t.wanted, t.cls) IN (SELECT (wanted, accepted) FROM al)),
r AS (SELECT case_id, wanted, CASE WHEN NOT (COALESCE(k0 IN ('ok','fail-safe'), false) AND (case_id, 0) IN (SELECT (case_id, side) FROM h)) THEN 'baseline lacks the class'
    WHEN NOT COALESCE(k1 IN ('ok','fail-safe'), false) THEN 'rewritten input gave no answer'
    WHEN (case_id, 1) NOT IN (SELECT (case_id, side) FROM h) THEN 'class lost after the rewrite' END AS reason FROM v)
SELECT case_id, wanted, reason IS NULL AS passed, reason FROM r"""
ORACLE["identity_invariant"] = f"""WITH {FINDINGS},
a AS (SELECT change_id, detector, severity, confidence FROM findings),
b AS (SELECT change_id, detector, CASE WHEN event_id % 10 = 0 THEN 'INFO' ELSE severity END AS severity, confidence FROM findings),
x AS (SELECT change_id, 1 AS l, 0 AS r FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
  SELECT change_id, 0, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT change_id, sum(l)::BIGINT AS only_before, sum(r)::BIGINT AS only_after FROM x GROUP BY change_id"""

# --- reports, jobs ---------------------------------------------------------------------------------------------
ORACLE["sarif_rules"] = f"WITH {FINDINGS} SELECT DISTINCT detector AS rule_id, category, CASE detector " + " ".join(
    f"WHEN '{d}' THEN '{','.join(t)}'" for d, t in V.TECHNIQUE_TAGS.items()) + " ELSE '' END AS tags FROM findings"
_ENTRY = "CASE " + " ".join(f"WHEN detector LIKE '{p}%' THEN '{n}'" for p, n in V.ENTRY_POINTS) + " ELSE 'main-import-side-effect' END"
_CAPABILITY = "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in V.CATEGORY_CAPABILITY.items()) + " END"
ORACLE["osif_incidents"] = f"""WITH {FINDINGS} SELECT package, direction, count(*) AS finding_count, arg_min({_ENTRY}, ({RANK}, detector, file)) AS entry_point,
  array_to_string(list_sort(list(DISTINCT {_CAPABILITY})), ',') AS capabilities, array_to_string(list_sort(list(DISTINCT detector)), ',') AS signals,
  CASE WHEN bool_or(detector = 'obf.entropy-jump') THEN 'obfuscation' ELSE '' END AS evasion FROM findings GROUP BY package, direction"""
ORACLE["osif_versions"] = f"WITH {FINDINGS} SELECT DISTINCT package, direction, to_ver AS version FROM findings"
ORACLE["osif_indicators"] = f"""WITH {FINDINGS} SELECT DISTINCT package, direction, regexp_extract(snippet, 'https?://[^\\s"''`)<>]+') AS url
  FROM findings WHERE detector LIKE 'net.%'"""
ORACLE["markdown_lines"] = f"""WITH {FINDINGS},
l AS (SELECT DISTINCT run_id, 0 AS section, '' AS a, '' AS b FROM findings UNION ALL SELECT DISTINCT run_id, {RANK} + 2, '', '' FROM findings
  UNION ALL SELECT DISTINCT run_id, {RANK} + 2, package, '' FROM findings UNION ALL SELECT run_id, {RANK} + 2, package, event_id::VARCHAR FROM findings)
SELECT run_id, section::INTEGER AS section, count(*) AS lines FROM l GROUP BY run_id, section"""
ORACLE["job_ttl"] = """WITH j AS (SELECT event_id, ts, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 30 SECOND END AS fin FROM events),
t AS (SELECT max(ts) AS now FROM events),
s AS (SELECT event_id::VARCHAR AS scan_id, CASE WHEN fin IS NULL THEN CASE WHEN now > ts + INTERVAL 24 HOUR THEN 'gone' ELSE 'pending' END
  WHEN now > fin + INTERVAL 24 HOUR THEN 'expired' WHEN event_id % 4 = 1 THEN 'error' ELSE 'done' END AS status FROM j, t)
SELECT scan_id, status, CASE WHEN status = 'error' THEN 'BLOCK' END AS verdict,
  CASE status WHEN 'gone' THEN 404 WHEN 'pending' THEN 202 WHEN 'expired' THEN 410 ELSE 200 END::INTEGER AS http_status FROM s"""
ORACLE["progress_counts"] = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {_pick(['analyze', 'cache-hit', 'error', 'done'], 'event_id % 4')} AS kind, count(*) AS n
  FROM events GROUP BY 1, 2"""

# --- sources -----------------------------------------------------------------------------------------------------
_KINDS = ["npm", "pnpm", "yarn-classic", "yarn-berry", "pypi-requirements", "pypi-poetry", "pypi-uv"]
LOCKS = f"""lf AS (SELECT 'f' || c_custkey AS run_id, c_custkey AS a, c_custkey % 9 AS b, {_pick(_KINDS, 'c_custkey % 7')} AS written,
  CASE WHEN c_custkey % 7 = 6 AND c_custkey % 10 = 3 THEN 'pypi-uv' ELSE {_pick(_KINDS, 'c_custkey % 7')} END AS kind FROM customer),
ln AS (SELECT run_id, kind, CASE WHEN kind LIKE 'pypi%' THEN 'pypi/' ELSE 'node_modules/' END AS lead,
    CASE WHEN kind IN ('npm','yarn-classic','yarn-berry') THEN 'A-' || a ELSE 'a-' || a END AS first_raw,
    CASE WHEN kind IN ('yarn-classic','yarn-berry') THEN 'A-' || a ELSE 'a-' || a END AS first_name, 'b-' || a AS second_name, a, b,
    CASE WHEN kind LIKE 'pypi%' THEN 'sha256-ab' || b WHEN kind LIKE 'yarn%' THEN 'sha512-xxxx' || b ELSE 'sha512-x' || b END AS integrity FROM lf)"""
ORACLE["lockfile_kinds"] = f"WITH {LOCKS} SELECT run_id, kind FROM lf"
ORACLE["lockfile_nodes"] = f"""WITH {LOCKS} SELECT run_id, lead || first_raw AS key, first_name AS name, '1.' || b || '.0' AS version, integrity FROM ln
UNION ALL SELECT run_id, lead || second_name, second_name, '2.0.' || b, '' FROM ln"""
ORACLE["lockfile_edges"] = f"""WITH {LOCKS} SELECT run_id, lead || first_raw AS parent_key, lead || second_name AS child_key FROM ln WHERE kind <> 'pypi-requirements'
UNION ALL SELECT run_id, '', lead || first_raw FROM ln WHERE kind IN ('npm','pnpm','pypi-requirements')
UNION ALL SELECT run_id, '', lead || second_name FROM ln WHERE kind = 'pypi-requirements'"""
ORACLE["lockfile_links"] = f"WITH {LOCKS} SELECT run_id, 'node_modules/w-' || a AS key, 'w-' || a AS name FROM lf WHERE kind = 'npm'"
_PACKAGE = "'p' || c_custkey AS name, '1.' || (c_custkey % 9) || '.0' AS version"
ORACLE["manifest_scripts"] = f"SELECT {_PACKAGE}, 'postinstall' AS hook, 'node ' || (c_custkey % 9) || '.js' AS body FROM customer"
ORACLE["manifest_dependencies"] = f"""SELECT {_PACKAGE}, 'dependencies' AS bucket, 'd' || (c_custkey % 9) AS dep, '^1.' || (c_custkey % 9) AS spec FROM customer
UNION ALL SELECT {_PACKAGE}, 'peerDependencies', 'q', 'http://h' || (c_custkey % 9) || '.example/q.tgz' FROM customer"""
ORACLE["manifest_emails"] = f"""SELECT {_PACKAGE}, 'maintainer' AS source, 'm' || (c_custkey % 9) || '@x.example' AS email FROM customer
UNION ALL SELECT {_PACKAGE}, 'author', 'a' || (c_custkey % 9) || '@y.example' FROM customer"""
ORACLE["manifest_entries"] = f"""SELECT {_PACKAGE}, unnest(['lib/' || c_custkey || '.js', 'esm/' || (c_custkey % 9) || '.mjs', 'bin/' || (c_custkey % 9) || '.js']) AS path FROM customer"""
ORACLE["preferred_artifacts"] = f"""WITH f AS (SELECT p_name AS name, '1.' || p_size AS version, p_partkey % 4 AS rank,
  'f' || p_partkey || {_pick(['-py3-none-any.whl', '-cp39.whl', '.tar.gz', '.zip'], 'p_partkey % 4')} AS filename FROM part)
SELECT name, version, arg_min(filename, (rank, filename)) AS filename FROM f WHERE rank < 3 GROUP BY name, version"""
_JS = f"""s AS (SELECT o_orderkey AS k, 'src/f' || o_orderkey || '.js' AS path, {_pick(T.JS_MODULES, 'o_orderkey % 5')} AS mod, {_pick(T.ENV_NAMES, 'o_custkey % 3')} AS env FROM orders)"""
ORACLE["scan_javascript"] = f"""WITH {_JS}
SELECT path, CASE o WHEN 0 THEN 'net_module' WHEN 1 THEN 'exec_module' WHEN 3 THEN 'net_module' ELSE 'fs_module' END AS cap, mod AS key, 1::INTEGER AS line, NULL::VARCHAR AS context
  FROM (SELECT *, k % 5 AS o FROM s) WHERE o <> 2
UNION ALL SELECT path, 'url', 'https://note' || k || '.example/q', 1, 'comment' FROM s
UNION ALL SELECT path, 'url', 'https://h' || k || '.example/p', 1, 'network-arg' FROM s
UNION ALL SELECT path, 'url', 'https://joined' || k || '.example/z', 1, NULL FROM s
UNION ALL SELECT path, 'env', env, 4, NULL FROM s
UNION ALL SELECT path, 'fs_write', '/etc/f' || k, 1, NULL FROM s
UNION ALL SELECT path, 'dynamic_code', path || ':8:eval', 8, NULL FROM s"""
_PY = _JS.replace(".js'", ".py'").replace(_pick(T.JS_MODULES, "o_orderkey % 5"), _pick(T.PY_MODULES, "o_orderkey % 5"))
ORACLE["scan_python"] = f"""WITH {_PY}
SELECT path, CASE k % 5 WHEN 1 THEN 'exec_module' WHEN 4 THEN 'fs_module' ELSE 'net_module' END AS cap, mod AS key, 1::INTEGER AS line FROM s WHERE k % 5 <> 2
UNION ALL SELECT path, 'fs_module', 'os', 1 FROM s
UNION ALL SELECT path, 'env', env, 4 FROM s
UNION ALL SELECT path, 'fs_write', '/etc/f' || k, 1 FROM s
UNION ALL SELECT path, 'url', 'https://h' || k || '.example/p', 1 FROM s
UNION ALL SELECT path, 'url', 'https://note' || k || '.example/q', 1 FROM s
UNION ALL SELECT path, 'dynamic_code', path || ':7:eval', 7 FROM s
UNION ALL SELECT path, 'exec_module', 'subprocess', 1 FROM s"""

# --- operators without a query of their own above ----------------------------------------------------------
ORACLE["encoded_urls"] = f"""WITH p AS (SELECT page_id, url, base64(encode(url)) AS b, hex(encode(url)) AS h, regexp_extract(url, {JS_URL_SQL}, 0) AS found FROM pages)
SELECT page_id, found, 'base64' AS encoding FROM p WHERE found <> '' AND length(b) BETWEEN 24 AND 4096
UNION ALL SELECT page_id, found, 'hex' FROM p WHERE found <> '' AND length(h) BETWEEN 24 AND 4096"""
ORACLE["first_per_key"] = """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"""
ORACLE["batch_slice"] = f"WITH {FINDINGS} SELECT event_id, package, severity FROM findings ORDER BY event_id LIMIT 200 OFFSET 200"
ORACLE["checked_findings"] = f"WITH {FINDINGS} SELECT event_id, detector FROM findings"
INSTANCES = """c AS (SELECT c_custkey AS c, 'top' || (c_custkey % 23) AS direct FROM customer),
o AS (SELECT o_orderkey AS o, direct, 'order' || (o_orderkey % 61) AS name FROM orders JOIN c ON c = o_custkey),
l AS (SELECT direct, 'part' || (l_partkey % 97) AS name FROM lineitem JOIN o ON o = l_orderkey),
closure AS (SELECT DISTINCT direct, direct AS name FROM c UNION SELECT direct, name FROM o UNION SELECT direct, name FROM l)"""
ORACLE["instance_closure"] = f"WITH {INSTANCES} SELECT direct, name FROM closure"
ORACLE["instance_rollup"] = f"""WITH {INSTANCES}, {FINDINGS},
per AS (SELECT 'part' || (event_id % 97) AS name, {RANK} AS rank FROM findings)
SELECT direct, {LABEL.format('COALESCE(min(rank), 3)')} AS max_severity, count(rank) AS count FROM closure LEFT JOIN per USING (name) GROUP BY direct"""
ORACLE["finding_order_dictionary"] = f"""WITH {FINDINGS} SELECT run_id, event_id, severity, package, detector, row_number() OVER (PARTITION BY run_id
  ORDER BY {RANK}, package COLLATE en, detector COLLATE en, file COLLATE en, evidence_line, event_id) AS place FROM findings"""
ORACLE["change_order_dictionary"] = f"""WITH {LOCK} SELECT run_id, name, kind, version_old, version_new, row_number() OVER (PARTITION BY run_id
  ORDER BY name, kind, coalesce(version_new, '') COLLATE en, coalesce(version_old, '') COLLATE en) AS place FROM changes"""
ORACLE["json_files"] = f"""SELECT 'p' || page_id || '.json' AS path, 'url' AS cap, key, NULL::VARCHAR AS context
FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, {JS_URL_SQL}, 1)) AS key FROM pages)"""
_WORST = LABEL.format(f"min({RANK})")
ORACLE["markdown_text"] = f"""WITH {FINDINGS}
SELECT run_id, '### behavioural diff' || chr(10) || chr(10) || '**' || {_WORST} || '** · ' || count(*) || ' finding(s) across 0 changed package(s).' || chr(10) AS line
FROM findings GROUP BY run_id
UNION ALL SELECT run_id, '#### ' || severity || ' (' || count(*) || ')' || chr(10) FROM findings GROUP BY run_id, severity
UNION ALL SELECT run_id, '  - **`' || detector || '`** — ' || message || chr(10) || '    - `' || file || ':' || evidence_line || '` — `'
  || CASE WHEN length(replace(snippet, '`', '\\`')) > 200 THEN substr(replace(snippet, '`', '\\`'), 1, 200) || ' …(truncated)' ELSE replace(snippet, '`', '\\`') END || '`' FROM findings"""
ORACLE["json_findings"] = f"""WITH {FINDINGS}
SELECT run_id, CAST(json_object('category', category, 'confidence', confidence, 'detector', detector, 'direction', direction,
  'evidence', json_array(json_object('file', file, 'line', evidence_line, 'snippet', snippet)), 'from', from_ver, 'message', message, 'mitre', json_array(),
  'package', package, 'provenance', json_array(), 'severity', severity, 'to', to_ver) AS VARCHAR) AS line FROM findings"""
ORACLE["sarif_results"] = f"""WITH {FINDINGS}
SELECT run_id, CAST(json_object('level', CASE severity WHEN 'BLOCK' THEN 'error' WHEN 'WARN' THEN 'warning' ELSE 'note' END,
  'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', package || '/' || file),
    'region', json_object('startLine', evidence_line, 'snippet', json_object('text', snippet))))),
  'message', json_object('text', '[' || package || ' ' || coalesce(from_ver, '') || '→' || coalesce(to_ver, '') || '] ' || message),
  'properties', json_object('confidence', confidence, 'from', from_ver, 'mitre', json_array(), 'package', package, 'to', to_ver),
  'ruleId', detector) AS VARCHAR) AS line FROM findings"""
ORACLE["findings_hash"] = f"""WITH {FINDINGS},
j AS (SELECT *, {RANK} AS rank, CAST(json_object('category', category, 'confidence', confidence, 'detector', detector, 'direction', direction,
  'evidence', json_array(json_object('file', file, 'line', evidence_line, 'snippet', snippet)), 'from', from_ver, 'message', message, 'mitre', json_array(),
  'package', package, 'provenance', json_array(), 'severity', severity, 'to', to_ver) AS VARCHAR) AS text FROM findings)
SELECT change_id, sha256('[' || string_agg(text, ',' ORDER BY rank, package, detector, file, evidence_line, text) || ']') AS findings_hash FROM j GROUP BY change_id"""


ORACLE["javascript_errors"] = SCRIPT_ERRORS
ORACLE["javascript_flow"] = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 + 1 AS steps FROM orders)
SELECT 'f' || k || '.js' AS path, 'env' AS cap, 'K' || (k % 5) AS key FROM o WHERE steps >= 3
UNION ALL SELECT 'f' || k || '.js', 'env', 'L' || k FROM o WHERE steps >= 4 UNION ALL SELECT 'f' || k || '.js', 'fs_write', '/d/' || k FROM o WHERE steps >= 6"""
ORACLE["json_leaves"] = """SELECT o_orderkey AS order_key, './o/' || o_orderpriority AS leaf, 1::BIGINT AS depth FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, './l/' || l_partkey || '.js', 3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, './"q" ' || l_returnflag, 5 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_FIXTURES = """f AS (SELECT o_custkey, 'd' || substr(o_orderpriority, 1, 1) AS detector, least(ascii(o_orderpriority) - 48, 3) AS rank FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT c_custkey AS fixture_id, c_nationkey AS year, c_mktsegment AS threat, c_nationkey % 4 <> 0 AS active,
  CASE min(rank) WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'WARN' WHEN 3 THEN 'INFO' ELSE 'CLEAN' END AS verdict, count(rank) AS findings,
  coalesce(string_agg(DISTINCT detector, ', ' ORDER BY detector), '') AS detectors
  FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment)"""
ORACLE["fixture_table"] = f"WITH {_FIXTURES} SELECT * FROM r"
ORACLE["detection_totals"] = f"""WITH {_FIXTURES}, levels AS (SELECT 'threat and year' AS level, threat, year, * EXCLUDE (threat, year) FROM r
  UNION ALL SELECT 'threat', threat, NULL, * EXCLUDE (threat, year) FROM r UNION ALL SELECT 'year', NULL, year, * EXCLUDE (threat, year) FROM r
  UNION ALL SELECT 'all', NULL, NULL, * EXCLUDE (threat, year) FROM r),
t AS (SELECT level, threat, year, count(*) AS fixtures, count(*) FILTER (active) AS measured, count(*) FILTER (active AND verdict <> 'CLEAN') AS caught,
  sum(findings)::BIGINT AS findings FROM levels GROUP BY level, threat, year)
SELECT level, threat, year, fixtures, measured, caught, measured - caught AS missed, findings,
  CASE WHEN measured > 0 THEN ((caught * 2000 + measured) // (2 * measured)) / 1000 END AS rate,
  CASE WHEN measured > 0 THEN ((caught * 2000 + measured) // (2 * measured) // 10) || '.' || ((caught * 2000 + measured) // (2 * measured) % 10) || '%' ELSE 'no data' END AS rate_text FROM t"""
_HASHED = f"""j AS (SELECT *, {RANK} AS rank, CAST(json_object('category', category, 'confidence', confidence, 'detector', detector, 'direction', direction,
  'evidence', json_array(json_object('file', file, 'line', evidence_line, 'snippet', snippet)), 'from', from_ver, 'message', message, 'mitre', json_array(),
  'package', package, 'provenance', json_array(), 'severity', severity, 'to', to_ver) AS VARCHAR) AS text FROM findings),
h AS (SELECT change_id, package, sha256('[' || string_agg(text, ',' ORDER BY rank, package, detector, file, evidence_line, text) || ']') AS findings_hash
  FROM j GROUP BY change_id, package)"""
ORACLE["receipt_hash"] = f"WITH {ADMIT}, {_HASHED} SELECT package, decision, sha256({RECEIPT}) AS receipt_hash FROM decided JOIN h USING (change_id, package)"
