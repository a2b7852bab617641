"""The queries of ``queries`` in DuckDB's SQL, on the same tables."""

from __future__ import annotations

from treeledger.queries import LAST_SYNC, NAMES, SIZES

PATH = "concat_ws('/', lang, source, lpad(doc_id::VARCHAR, 8, '0') || '.txt')"
OWNER = "unhex('e8030000e8030000')"


def le32(x: str) -> str:
    h = f"printf('%08x', {x})"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in (7, 5, 3, 1)) + ")"


def blob(mode: str, content: str) -> str:
    return f"sha256({OWNER} || {le32(mode)} || unhex('00000000') || {content})"


def text_bytes(x: str) -> str:
    return f"coalesce(encode({x}), ''::BLOB)"


def files(n: int) -> str:
    """CTE files{n}: path, kind, mode, content; hashed{n}: with hash and length."""
    if n == 1:
        rows = f"SELECT {PATH} AS path, 'regular' AS kind, 33188::BIGINT AS mode, {text_bytes('text')} AS content FROM documents WHERE doc_id % 11 <> 0"
    else:
        text = "CASE WHEN doc_id % 19 = 0 THEN '../' || doc_id WHEN doc_id % 7 = 0 THEN text || ' [edited]' ELSE text END"
        rows = f"""SELECT {PATH} AS path, CASE WHEN doc_id % 19 = 0 THEN 'symlink' ELSE 'regular' END AS kind,
            (CASE WHEN doc_id % 19 = 0 THEN 41471 WHEN doc_id % 17 = 0 THEN 33261 ELSE 33188 END)::BIGINT AS mode, {text_bytes(text)} AS content
            FROM documents WHERE doc_id % 13 <> 0 AND NOT (lang = 'de' AND source = 'src5')
            UNION ALL SELECT 'de/src5', 'regular', 33188, encode('now a file')"""
    return f"files{n} AS ({rows}), hashed{n} AS (SELECT *, {blob('mode', 'content')} AS hash, octet_length(content)::BIGINT AS length FROM files{n})"


def with_dirs(name: str, source: str, mode: str) -> str:
    """CTE name: rows of source (path, kind, hash, size, target_path) and their directories."""
    return f"""{name} AS (SELECT path, kind, hash, size, target_path, NULL::BIGINT AS uid, NULL::BIGINT AS gid, NULL::BIGINT AS mode FROM {source}
        UNION ALL SELECT path, 'directory', NULL, NULL, NULL, 0, 0, {mode} FROM (
            SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM {source}, range(1, 8) t(i) WHERE i < len(string_split(path, '/')) GROUP BY 1)
        WHERE path NOT IN (SELECT path FROM {source}))"""


def snapshot(n: int) -> str:
    """CTE v{n}: the flattened snapshot."""
    keep = "min" if n == 1 else "max"
    mode = "16877" if n == 1 else "CASE WHEN path ~ '^[^/]+/src3$' THEN 16832 ELSE 16877 END"
    return (
        files(n)
        + f""", first{n} AS (SELECT *, {keep}(path) OVER (PARTITION BY kind, hash) AS f FROM hashed{n}),
        named{n} AS (SELECT path, CASE WHEN path <> f THEN 'hardlink' ELSE kind END AS kind, CASE WHEN path = f THEN hash END AS hash,
            CASE WHEN path = f AND kind = 'regular' THEN length END AS size, CASE WHEN path <> f THEN f END AS target_path FROM first{n}), """
        + with_dirs(f"v{n}", f"named{n}", mode)
    )


def merkle(source: str, out: str, deepest: int = 3) -> str:
    """CTE out: source with directory hashes, n_entries and the root ''."""
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n')"
    cols = ["kind", "coalesce(hash, '')", "coalesce(size::VARCHAR, '')", f"coalesce({esc('target_path')}, '')", "''", "''", "coalesce(uid::VARCHAR, '')", "coalesce(gid::VARCHAR, '')", "coalesce(mode::VARCHAR, '')", "'-'", "''"]
    line = " || chr(9) || ".join([esc("regexp_extract(path, '[^/]*$')"), *cols])
    parts = [f"{out}_{deepest} AS (SELECT *, 0::BIGINT AS n_entries FROM {source} WHERE len(string_split(path, '/')) = {deepest})"]
    for level in range(deepest - 1, -1, -1):
        below = f"{out}_{level + 1}"
        here = f"SELECT * FROM {source} WHERE len(string_split(path, '/')) = {level}" if level else "SELECT '' AS path, 'directory' AS kind, NULL AS hash, NULL::BIGINT AS size, NULL AS target_path, NULL::BIGINT AS uid, NULL::BIGINT AS gid, NULL::BIGINT AS mode"
        parts.append(f"""{out}_{level} AS (
            WITH lines AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS up, regexp_extract(path, '[^/]*$') AS name, substr(sha256(regexp_extract(path, '[^/]*$')), 1, 2) AS bucket, {line} AS line FROM {below}),
            buckets AS (SELECT up, bucket, sha256(string_agg(line, chr(10) ORDER BY name)) AS h, count(*) AS n FROM lines GROUP BY 1, 2),
            whole AS (SELECT up, sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS tree_hash, sum(n)::BIGINT AS n_entries FROM buckets GROUP BY 1)
            SELECT s.path, kind, CASE WHEN kind = 'directory' THEN coalesce(tree_hash, sha256('')) ELSE hash END AS hash, size, target_path, uid, gid, mode, CASE WHEN kind = 'directory' THEN coalesce(w.n_entries, 0) END AS n_entries
            FROM ({here}) s LEFT JOIN whole w ON w.up = s.path)""")
    parts.append(f"{out} AS (" + " UNION ALL ".join(f"SELECT * FROM {out}_{i}" for i in range(deepest + 1)) + ")")
    return ", ".join(parts)


COMPARED = """pairs AS (SELECT path, a.kind AS ak, b.kind AS bk,
        CASE WHEN a.kind IS NULL THEN 'A' WHEN b.kind IS NULL THEN 'D'
             WHEN a.kind = 'directory' AND b.kind = 'directory' THEN CASE WHEN (a.uid, a.gid, a.mode) IS DISTINCT FROM (b.uid, b.gid, b.mode) THEN 'm' END
             WHEN a.kind <> b.kind THEN 'M' WHEN a.hash IS DISTINCT FROM b.hash THEN 'M'
             WHEN a.size IS DISTINCT FROM b.size OR a.target_path IS DISTINCT FROM b.target_path OR a.uid IS DISTINCT FROM b.uid OR a.gid IS DISTINCT FROM b.gid OR a.mode IS DISTINCT FROM b.mode THEN 'm' END AS change
        FROM {a} a FULL OUTER JOIN {b} b USING (path)),
    swapped AS (SELECT path FROM pairs WHERE change IS NOT NULL AND ak IS NOT NULL AND bk IS NOT NULL AND (ak = 'directory') <> (bk = 'directory')),
    changes AS (SELECT path, change AS kind FROM pairs p WHERE change IS NOT NULL
        AND NOT (change IN ('A', 'D') AND EXISTS (SELECT 1 FROM swapped s WHERE starts_with(p.path, s.path || '/'))))"""
DIFF = f"WITH {snapshot(1)}, {snapshot(2)}, {COMPARED.format(a='v1', b='v2')} "
SAME = f"WITH {snapshot(1)}, {COMPARED.format(a='v1', b='v1')} "

PERMS = "(CASE m & 61440 WHEN 32768 THEN '-' WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '?' END || " + " || ".join(f"CASE WHEN m & {256 >> i} <> 0 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9)) + ")"


def layers(conflict: bool = False) -> str:
    """CTE layers: (idx, path, kind, hash, mode) of the three snapshots to merge."""
    parts = []
    for i, (mod, suffix) in enumerate(((2, ""), (3, "x"), (5, ""))):
        hash_ = blob("33188", text_bytes(f"text || '{suffix}'"))
        rows = f"SELECT {PATH} AS path, 'regular' AS kind, {hash_} AS hash, octet_length({text_bytes(f"text || '{suffix}'")})::BIGINT AS size, NULL::VARCHAR AS target_path FROM documents WHERE doc_id % {mod} = 0"
        if conflict and i == 1:
            file = blob("33188", "encode('file')")
            rows = f"SELECT * FROM ({rows}) WHERE NOT starts_with(path, 'en/src0/') UNION ALL SELECT 'en/src0', 'regular', {file}, NULL, NULL"
        parts.append(f"l{i}_files AS ({rows}), " + with_dirs(f"l{i}", f"l{i}_files", str(16877 - i)))
    stack = " UNION ALL ".join(f"SELECT {i} AS idx, * FROM l{i}" for i in range(3))
    return ", ".join(parts) + f""", layers AS ({stack}),
        groups AS (SELECT path, count(*) AS n, bool_and(kind = 'directory') AS all_dirs, bool_or(kind = 'directory') AS any_dir FROM layers GROUP BY path)"""


def merged(how: str, columns: str = "path, kind, hash, mode") -> str:
    order = "CASE WHEN kind = 'directory' THEN -idx ELSE idx END" if how == "first" else "-idx"
    return f"WITH {layers()} SELECT {columns} FROM layers QUALIFY row_number() OVER (PARTITION BY path ORDER BY {order}) = 1"


COMMITS = """ev AS (SELECT *, sha256('commit ' || event_id) AS hash, sha256('tree ' || (event_id % 500)) AS tree, lag(sha256('commit ' || event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p1 FROM events),
    commits AS (SELECT a.event_id, a.user_id, a.ts, a.hash, a.tree, a.p1,
        CASE WHEN a.event_type = 'purchase' THEN (SELECT max_by(b.hash, b.ts) FROM ev b WHERE b.user_id = a.user_id + 1 AND b.ts < a.ts) END AS p2,
        'user' || a.user_id AS author, epoch(a.ts::TIMESTAMP)::BIGINT AS timestamp, a.event_type AS message, a.props ->> '$.k' AS k FROM ev a),
    edges AS (SELECT hash AS child, p1 AS parent FROM commits WHERE p1 IS NOT NULL UNION SELECT hash, p2 FROM commits WHERE p2 IS NOT NULL),
    heads AS (SELECT 'users/' || user_id AS name, max_by(hash, (ts, event_id)) AS hash FROM commits GROUP BY user_id)"""
#: floor, not rounding, of the seconds
COMMITS = COMMITS.replace("epoch(a.ts::TIMESTAMP)::BIGINT", "floor(epoch(a.ts::TIMESTAMP))::BIGINT")
LOG = f"""WITH RECURSIVE {COMMITS}, reach AS (SELECT hash FROM heads WHERE name = 'users/7' UNION SELECT parent FROM reach JOIN edges ON child = hash)
    SELECT hash, timestamp, author, message FROM reach JOIN commits USING (hash)"""
STORE = f"""{COMMITS}, entries AS (SELECT sha256('tree ' || t) AS tree_hash, 'f' || i AS name, sha256('blob ' || ((t * 7 + i) % 600)) AS hash
        FROM (SELECT DISTINCT event_id % 500 AS t FROM events), range(0, 3) r(i) WHERE i <= t % 3),
    blobs AS (SELECT sha256('blob ' || id) AS hash, id * 3 + 10 AS length FROM range(700) b(id) WHERE id % 53 <> 5),
    roots AS (SELECT * FROM heads WHERE NOT regexp_matches(name, '0$'))"""


def reach(stored: str) -> str:
    """CTEs reach, marked_trees, uses from roots over a table of commits."""
    return f"""reach AS (SELECT hash FROM roots UNION SELECT parent FROM reach JOIN {stored} c USING (hash) JOIN edges ON child = c.hash),
    marked_trees AS (SELECT DISTINCT tree AS hash FROM {stored} JOIN reach USING (hash)),
    uses AS (SELECT e.hash, tree_hash, name FROM entries e JOIN marked_trees m ON m.hash = tree_hash)"""


FULL = f"WITH RECURSIVE {STORE}, trees AS (SELECT tree_hash AS hash, count(*) AS length FROM entries GROUP BY 1), {reach('commits')} "
DAMAGED = f"""WITH RECURSIVE {STORE}, kept AS (SELECT * FROM commits WHERE event_id % 97 <> 0),
    trees AS (SELECT DISTINCT sha256('tree ' || (event_id % 500)) AS hash FROM events WHERE event_id % 500 % 41 <> 3), {reach('kept')} """


def commit_id(parents: str) -> str:
    return f"""sha256('tree ' || tree || chr(10) || 'parents ' || {parents} || chr(10) || 'author ' || author || chr(10) || 'time ' || timestamp || chr(10)
        || 'meta ' || coalesce('k=' || k, '') || chr(10) || message)"""


def ranges(x: str, outward: bool, shift: int = 0) -> str:
    rows = [(0, 1000 + shift, 1), (1, 100000 + shift, 65536)]
    out = ""
    for inside, outside, n in rows:
        a, b = (inside, outside) if outward else (outside, inside)
        out += f" WHEN {x} >= {a} AND {x} < {min(a + n, 2**32 - 1)} THEN {x} - {a} + {b}"
    return f"(CASE{out} END)::BIGINT"


OWNERS = "(SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 1000 WHEN doc_id % 7 = 0 THEN doc_id ELSE 100000 + doc_id * 131 % 70000 END)::BIGINT AS uid, 100000 + doc_id % 50 AS gid FROM documents)"
REMAP = f"""WITH a AS (SELECT *, {ranges('uid', False)} AS iu, {ranges('gid', False)} AS ig FROM {OWNERS}),
    b AS (SELECT *, {ranges('iu', True, 100000)} AS new_uid, {ranges('ig', True, 100000)} AS new_gid FROM a),
    c AS (SELECT doc_id, new_uid, new_gid, CASE WHEN iu IS NULL OR ig IS NULL THEN 'skipped_unmapped_source' WHEN new_uid IS NULL OR new_gid IS NULL THEN 'skipped_unmapped_target'
        WHEN new_uid = uid AND new_gid = gid THEN 'no_change' ELSE 'remapped' END AS outcome FROM b) """
TREE = """WITH files AS (SELECT r_name || '/' || n_name || '/' || replace(c_name, '/', '_') || '/' || o_orderkey AS path, concat_ws('|', o_orderpriority, o_orderstatus, (o_orderkey % 50)::VARCHAR) AS key, o_orderkey FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT path, string_split(path, '/') AS parts, sha256(key) AS hash, octet_length(encode(key)) * 10 + o_orderkey % 50 AS size FROM files),
    units AS (SELECT {cut} AS parts, sum(size) AS bytes FROM (SELECT DISTINCT {cut} AS parts, hash, size FROM f) f GROUP BY 1)
    SELECT array_to_string(parts[1:i], '/') AS path, sum(bytes)::BIGINT AS bytes FROM units, range(1, {d} + 1) r(i) GROUP BY 1"""
CURRENT = f"WITH {COMMITS} SELECT 'heads' AS namespace, name, hash FROM heads WHERE NOT regexp_matches(name, '[^0-9]([0-9]*0)$')"
ARTIFACT = "sha256(sha256('tree ' || p_size) || chr(10) || sha256(p_name) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'outputs/bin' ELSE 'bundles/dev' END)"
PARTS = f"(SELECT replace(p_brand, '#', '-') || '/' || replace(p_type, ' ', '-') || '/' || p_partkey AS path, {ARTIFACT} AS hash FROM part)"


def human(n: str) -> str:
    x, out = f"{n}::DOUBLE", f"CASE WHEN {n} < 1024 THEN printf('%5d', {n})"
    for k, unit in enumerate("KMGTP", 1):
        v = f"({x} / {1024**k})"
        out += f" WHEN {v} < {1024 if unit != 'P' else 1e300} THEN CASE WHEN {v} >= 10 THEN printf('%4.0f{unit}', {v}) ELSE printf('%3.1f{unit}', {v}) END"
    return out + " END"


def name_rows() -> str:
    return ", ".join(f"('{n.encode().hex().upper()}', {str(bool(n) and chr(0) not in n and not set(n.split('/')) & {'', '.', '..'}).lower()})" for n in NAMES)


CONTENT_HASH = "CASE WHEN v.kind IN ('regular', 'symlink') THEN sha256(b.content) WHEN v.kind = 'hardlink' THEN sha256('-> ' || target_path) ELSE sha256(v.kind) END"

ORACLE_SQL = {
    "blob_hashes": f"SELECT doc_id, {blob('33188', text_bytes('text'))} AS hash FROM documents",
    "symlink_hashes": f"SELECT doc_id, {blob('41471', text_bytes(chr(39) + '../' + chr(39) + ' || doc_id'))} AS hash FROM documents",
    "blob_dedup": f"WITH {files(1)} SELECT hash, max(length) AS length, count(*) AS n FROM hashed1 GROUP BY hash",
    "dedup_ratio": f"WITH {files(1)} SELECT count(*) AS entries, sum(length)::BIGINT AS total_bytes, count(DISTINCT hash) AS distinct_blobs, (SELECT sum(l)::BIGINT FROM (SELECT max(length) AS l FROM hashed1 GROUP BY hash)) AS stored_bytes FROM hashed1",
    "new_blobs": f"WITH {files(1)}, {files(2)} SELECT hash, max(length) AS length FROM hashed2 WHERE hash NOT IN (SELECT hash FROM hashed1) GROUP BY hash",
    "tree_hash_by_dir": f"WITH {snapshot(1)}, {merkle('v1', 'm')} SELECT path, hash, n_entries FROM m WHERE kind = 'directory'",
    "root_hash": f"WITH {snapshot(2)}, {merkle('v2', 'm')} SELECT hash FROM m WHERE path = ''",
    "diff": DIFF + "SELECT * FROM changes",
    "diff_summary": DIFF + "SELECT kind, count(*) AS n FROM changes GROUP BY kind",
    "diff_identical": SAME + "SELECT * FROM changes",
    "diff_type_change": DIFF + "SELECT path, ak AS old_kind, bk AS new_kind FROM pairs WHERE path IN (SELECT path FROM swapped)",
    "diff_metadata_only": DIFF + "SELECT * FROM changes WHERE kind = 'm'",
    "diff_pruned": DIFF + "SELECT * FROM changes",
    "ls_tree_root": f"WITH {snapshot(1)} SELECT path, kind FROM v1 WHERE NOT contains(path, '/')",
    "ls_tree_path": f"WITH {snapshot(1)} SELECT path, kind, hash, size FROM v1 WHERE regexp_replace(path, '/?[^/]*$', '') = 'en/src3'",
    "ls_tree_recursive": f"WITH {snapshot(1)}, {merkle('v1', 'm')} SELECT path, CASE kind WHEN 'directory' THEN '040000' WHEN 'symlink' THEN '120000' ELSE '100644' END || ' ' || kind || ' ' || coalesce(substr(hash, 1, 12), '------------') || '    ' || path AS line FROM m WHERE path <> ''",
    "ls_tree_long": f"""WITH {snapshot(2)}, b AS (SELECT hash, max(mode) AS bm, max(length) AS bl FROM hashed2 GROUP BY hash),
        x AS (SELECT path, v.kind, target_path, CASE v.kind WHEN 'directory' THEN 16384 | (mode & 4095) WHEN 'symlink' THEN 41471 WHEN 'regular' THEN bm END AS m, CASE v.kind WHEN 'regular' THEN size WHEN 'symlink' THEN bl ELSE 0 END AS s,
            CASE WHEN v.kind IN ('regular', 'symlink') THEN 1000 ELSE 0 END AS o FROM v2 v LEFT JOIN b USING (hash))
        SELECT path, CASE WHEN kind = 'hardlink' THEN '----------' ELSE {PERMS} END || printf(' %5d %5d %8d ', o, o, s) || path || CASE WHEN kind = 'hardlink' THEN ' -> ' || target_path ELSE '' END AS line FROM x""",
    "human_sizes": f"SELECT DISTINCT size, {human('size')} AS text FROM (SELECT unnest([{', '.join(map(str, SIZES))}])::BIGINT AS size UNION SELECT octet_length(encode(text))::BIGINT FROM documents WHERE text IS NOT NULL)",
    "cat_file": f"WITH {snapshot(2)}, b AS (SELECT hash, any_value(content) AS content FROM hashed2 GROUP BY hash) SELECT path, v.kind, {CONTENT_HASH} AS shown_hash FROM v2 v LEFT JOIN b USING (hash)",
    "export_hardlink": f"WITH {snapshot(1)} SELECT v.path, coalesce(t.kind, v.kind) AS kind, coalesce(t.hash, v.hash) AS hash, coalesce(t.size, v.size) AS size FROM v1 v LEFT JOIN v1 t ON t.path = v.target_path WHERE coalesce(t.kind, v.kind) IN ('regular', 'symlink')",
    "union_first": merged("first"),
    "union_last": merged("last"),
    "union_conflicts": f"WITH {layers()} SELECT path FROM groups WHERE n > 1 AND NOT any_dir",
    "union_type_conflicts": f"WITH {layers(True)} SELECT path FROM groups WHERE any_dir AND NOT all_dirs",
    "union_dir_meta": f"SELECT path, mode FROM ({merged('last')}) WHERE kind = 'directory'",
    "log": LOG,
    "log_limit": f"SELECT hash, timestamp FROM ({LOG}) ORDER BY timestamp DESC, hash LIMIT 10",
    "log_text": f"WITH {COMMITS} SELECT hash, 'commit ' || hash || chr(10) || 'Author: ' || author || chr(10) || 'Date:   ' || strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10) || CASE WHEN message = '' THEN '' ELSE chr(10) || '    ' || replace(message, chr(10), chr(10) || '    ') || chr(10) END AS text FROM commits",
    "merge_commits": f"WITH {COMMITS} SELECT hash, p1 AS first, p2 AS second FROM commits WHERE p1 IS NOT NULL AND p2 IS NOT NULL",
    "root_commits": f"WITH {COMMITS} SELECT hash, author FROM commits WHERE p1 IS NULL AND p2 IS NULL",
    "commit_metadata": f"WITH {COMMITS} SELECT hash, substr(hash, 1, 12) AS short, coalesce('k=' || k, '') AS metadata FROM commits",
    "is_ancestor": f"""WITH RECURSIVE {COMMITS}, firsts AS (SELECT user_id, min_by(hash, (ts, event_id)) AS old FROM commits GROUP BY 1),
        p AS (SELECT old, h.hash AS new FROM heads h JOIN firsts ON user_id IN (regexp_extract(name, '[0-9]+$')::BIGINT, regexp_extract(name, '[0-9]+$')::BIGINT + 1)),
        q AS (SELECT old, new FROM p UNION SELECT new, old FROM p),
        r AS (SELECT new AS root, new AS node FROM q UNION SELECT root, parent FROM r JOIN edges ON child = node)
        SELECT old, new, EXISTS (SELECT 1 FROM r WHERE root = new AND node = old) AS ok FROM q""",
    "reachable_commits": FULL + "SELECT hash FROM reach",
    "gc_dry_run": FULL + """SELECT 'commit' AS object_type, count(*) AS removed, count(*) AS bytes FROM commits WHERE hash NOT IN (SELECT hash FROM reach)
        UNION ALL SELECT 'tree', count(*), coalesce(sum(length), 0)::BIGINT FROM trees WHERE hash NOT IN (SELECT hash FROM marked_trees)
        UNION ALL SELECT 'blob', count(*), coalesce(sum(length), 0)::BIGINT FROM blobs WHERE hash NOT IN (SELECT hash FROM uses)""",
    "stats": FULL + """SELECT (SELECT count(*) FROM blobs) AS blobs, (SELECT sum(length)::BIGINT FROM blobs) AS blob_bytes, (SELECT count(DISTINCT hash) FROM uses) AS reachable_blobs,
        (SELECT count(*) FROM trees) AS trees, (SELECT sum(length)::BIGINT FROM trees) AS tree_bytes, (SELECT count(*) FROM marked_trees) AS reachable_trees,
        (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM commits) AS commit_bytes, (SELECT count(*) FROM reach) AS reachable_commits,
        (SELECT coalesce(sum(length), 0)::BIGINT FROM blobs WHERE hash NOT IN (SELECT hash FROM uses)) AS unreachable_bytes, (SELECT count(*) FROM roots) AS refs""",
    "fsck_missing": DAMAGED + """SELECT 'commit' AS object_type, hash, '' AS detail FROM reach WHERE hash NOT IN (SELECT hash FROM kept)
        UNION ALL SELECT 'tree', hash, '' FROM marked_trees WHERE hash NOT IN (SELECT hash FROM trees)
        UNION ALL SELECT 'blob', hash, tree_hash || '/' || name FROM uses WHERE hash NOT IN (SELECT hash FROM blobs)""",
    "fsck_dangling": DAMAGED + """SELECT 'commit' AS object_type, hash FROM kept WHERE hash NOT IN (SELECT hash FROM reach)
        UNION ALL SELECT 'tree', hash FROM trees WHERE hash NOT IN (SELECT hash FROM marked_trees) UNION ALL SELECT 'blob', hash FROM blobs WHERE hash NOT IN (SELECT hash FROM uses)""",
    "fsck_corrupt": "SELECT 'commit' AS object_type, sha256('bad ' || event_id) AS hash FROM events WHERE event_id % 101 = 0",
    "transfer_needed": FULL + f""", old AS (SELECT * FROM commits WHERE ts < TIMESTAMP '{LAST_SYNC}')
        SELECT 'commit' AS object_type, hash FROM reach WHERE hash NOT IN (SELECT hash FROM old) UNION ALL SELECT 'tree', hash FROM marked_trees WHERE hash NOT IN (SELECT tree FROM old)
        UNION ALL SELECT DISTINCT 'blob', hash FROM uses WHERE hash NOT IN (SELECT e.hash FROM entries e WHERE tree_hash IN (SELECT tree FROM old))""",
    "transfer_shallow": FULL + "SELECT hash, tree FROM commits WHERE hash IN (SELECT hash FROM roots)",
    "fast_forward": f"""WITH RECURSIVE {COMMITS}, theirs AS (SELECT 'users/' || user_id AS name, max_by(hash, (ts, event_id)) AS hash FROM commits WHERE ts < TIMESTAMP '{LAST_SYNC}' GROUP BY user_id),
        moved AS (SELECT name, CASE WHEN name = 'users/11' THEN (SELECT hash FROM theirs WHERE name = 'users/2') ELSE hash END AS hash FROM theirs),
        ours AS (SELECT h.name, h.hash AS new, m.hash AS old FROM heads h LEFT JOIN moved m USING (name)),
        r AS (SELECT new AS root, new AS node FROM ours UNION SELECT root, parent FROM r JOIN edges ON child = node)
        SELECT name, old IS NULL OR EXISTS (SELECT 1 FROM r WHERE root = new AND node = old) AS ok FROM ours""",
    "truncate_history": f"WITH {COMMITS} SELECT name, hash AS old_hash, {commit_id(chr(39) * 2)} AS hash FROM heads JOIN commits USING (hash) WHERE p1 IS NOT NULL OR p2 IS NOT NULL",
    "truncate_stats": f"WITH {COMMITS} SELECT count(*) AS refs_processed, count(*) FILTER (p1 IS NOT NULL OR p2 IS NOT NULL) AS refs_truncated FROM heads JOIN commits USING (hash)",
    "outside_to_inside": f"SELECT doc_id, {ranges('uid', False)} AS inside FROM {OWNERS}",
    "inside_to_outside": f"SELECT doc_id, {ranges('(doc_id * 977 % 70000)', True)} AS outside FROM documents",
    "remap": REMAP + "SELECT * FROM c",
    "remap_stats": REMAP + "SELECT outcome, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM c",
    "latest_ref": CURRENT,
    "refs_list": f"SELECT name, hash FROM ({CURRENT})",
    "refs_glob": f"SELECT name, hash FROM ({CURRENT}) WHERE regexp_full_match(name, 'users/[^2-9].')",
    "ref_validate": f"SELECT * FROM (VALUES {name_rows()}) t(name_hex, ok)",
    "resolve_ref": f"SELECT spec, CASE WHEN length(spec) = 64 THEN lower(spec) ELSE hash END AS hash FROM (VALUES ('users/7'), ('users/10'), ('{'A' * 64}'), ('nope')) t(spec) LEFT JOIN ({CURRENT}) ON name = spec",
    "hardlink_groups": f"""WITH f AS (SELECT {PATH} AS path, doc_id % 40 AS ino FROM documents WHERE doc_id % 3 = 0), g AS (SELECT *, min(path) OVER (PARTITION BY ino) AS first_path FROM f)
        SELECT path, first_path FROM g WHERE path <> first_path""",
    "sparse_layout": f"""WITH f AS (SELECT doc_id, {text_bytes('text')} AS c FROM documents), h AS (SELECT doc_id, hex(c) AS x FROM f),
        g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN x ELSE substr(x, 1, 20) || substr(x, 81, 40) END AS x FROM h)
        SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 60 END)::BIGINT AS total, (length(x) // 2)::BIGINT AS stored, sha256(unhex(x)) AS data_hash FROM g""",
    "artifact_hashes": f"SELECT * FROM {PARTS}",
    "artifact_refs_glob": f"SELECT path AS name, hash FROM {PARTS} WHERE regexp_full_match(path, 'Brand-1.*/.*/.*7')",
}
USAGE = FULL + "SELECT name AS ref_name, coalesce(sum(length), 0)::BIGINT AS bytes FROM (SELECT DISTINCT name, e.hash FROM roots JOIN commits USING (hash) JOIN (SELECT tree_hash, hash FROM entries) e ON tree_hash = tree) LEFT JOIN blobs USING (hash)"
ORACLE_SQL |= {"du_refs": USAGE + " GROUP BY name", "du_refs_glob": USAGE + " WHERE name LIKE 'users/1%' GROUP BY name"}
ORACLE_SQL |= {f"du_tree_{d}": TREE.replace("{cut}", f"parts[1:{d}]").replace("{d}", str(d)) for d in (1, 2, 3)}
UNION_ROOT = merged("last", "*").removeprefix("WITH ")
#: Objects of two snapshots with directories in directories; trees and blobs are damaged by path and hash.
NESTED = f"""WITH RECURSIVE {snapshot(1)}, {snapshot(2)}, {merkle('v1', 'm1')}, {merkle('v2', 'm2')},
    entries AS (SELECT DISTINCT p.hash AS tree_hash, p.path AS up, regexp_extract(c.path, '[^/]*$') AS name, c.kind, c.hash, c.n_entries, t.n FROM (SELECT 1 AS n, * FROM m1 UNION ALL SELECT 2, * FROM m2) c
        JOIN (SELECT 1 AS n, * FROM m1 UNION ALL SELECT 2, * FROM m2) p ON p.n = c.n AND p.path = regexp_replace(c.path, '/?[^/]*$', '') JOIN (VALUES (1), (2)) t(n) ON t.n = c.n WHERE c.path <> '' AND p.kind = 'directory'),
    all_trees AS (SELECT DISTINCT hash, n_entries AS length, n FROM (SELECT 1 AS n, * FROM m1 UNION ALL SELECT 2, * FROM m2) WHERE kind = 'directory'),
    all_blobs AS (SELECT DISTINCT hash, length, n FROM (SELECT 1 AS n, hash, length FROM hashed1 UNION ALL SELECT 2, hash, length FROM hashed2)) """
DAMAGED_NESTED = NESTED + """, kept AS (SELECT * FROM entries WHERE n = 1 AND up <> 'de/src3' AND NOT (up = 'en/src1' AND name = (SELECT min(name) FROM entries WHERE n = 1 AND up = 'en/src1'))),
    reached AS (SELECT hash FROM m1 WHERE path = '' UNION SELECT e.hash FROM kept e JOIN reached r ON tree_hash = r.hash WHERE kind = 'directory'),
    trees AS (SELECT hash FROM m1 WHERE kind = 'directory' AND path <> 'de/src3' UNION SELECT sha256('stray')),
    blobs AS (SELECT hash FROM all_blobs WHERE n = 1 AND substr(hash, 1, 1) <> '7'),
    uses AS (SELECT tree_hash, name, hash FROM kept WHERE kind IN ('regular', 'symlink') AND tree_hash IN (SELECT hash FROM reached)),
    report AS (SELECT 'corrupt' AS status, 'tree' AS object_type, hash, '' AS detail FROM m1 WHERE path = 'en/src1' AND n_entries > 1
        UNION ALL SELECT 'missing', 'tree', hash, '' FROM reached WHERE hash NOT IN (SELECT hash FROM trees) UNION ALL SELECT 'missing', 'blob', hash, tree_hash || '/' || name FROM uses WHERE hash NOT IN (SELECT hash FROM blobs)
        UNION ALL SELECT 'dangling', 'tree', hash, '' FROM trees WHERE hash NOT IN (SELECT hash FROM reached) UNION ALL SELECT 'dangling', 'blob', hash, '' FROM blobs WHERE hash NOT IN (SELECT hash FROM uses)) """
ORACLE_SQL |= {
    "reachable_commits_doubled": ORACLE_SQL["reachable_commits"],
    "hash_paths": f"SELECT doc_id, substr(hash, 1, 2) || '/' || substr(hash, 3) AS place FROM ({ORACLE_SQL['blob_hashes']})",
    "log_positions": f"SELECT row_number() OVER (ORDER BY timestamp DESC, hash) AS pos, hash FROM ({LOG}) QUALIFY pos <= 500",
    "flatten_tree": f"WITH {snapshot(1)}, {merkle('v1', 'm')} SELECT path, kind, hash FROM m WHERE path <> ''",
    "fsck_nested": DAMAGED_NESTED + "SELECT * FROM report",
    "fsck_counts": DAMAGED_NESTED + """SELECT (SELECT count(*) FROM trees) + (SELECT count(*) FROM blobs) + 1 AS objects_checked, count_if(status = 'corrupt')::BIGINT AS corrupt, count_if(status = 'missing')::BIGINT AS missing,
        count_if(status = 'dangling')::BIGINT AS dangling FROM report""",
    "gc_nested": NESTED + """SELECT 'commit' AS object_type, 1::BIGINT AS removed, 1::BIGINT AS bytes
        UNION ALL SELECT 'tree', count(*), coalesce(sum(length), 0)::BIGINT FROM (SELECT DISTINCT hash, length FROM all_trees WHERE hash NOT IN (SELECT hash FROM all_trees WHERE n = 1))
        UNION ALL SELECT 'blob', count(*), coalesce(sum(length), 0)::BIGINT FROM (SELECT DISTINCT hash, length FROM all_blobs WHERE hash NOT IN (SELECT hash FROM all_blobs WHERE n = 1))""",
}
ORACLE_SQL["union_root_hash"] = f"WITH u AS (WITH {UNION_ROOT}), v AS (SELECT path, kind, hash, CASE WHEN kind = 'regular' THEN size END AS size, NULL::VARCHAR AS target_path, uid, gid, mode FROM u), {merkle('v', 'm')} SELECT hash FROM m WHERE path = ''"
