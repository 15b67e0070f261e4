"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from echofold.functions.text import TRACK_PREFIX
from echofold.schema import AUDIO_SUFFIXES

LATEST = """
latest AS (SELECT path, mtime, duration, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY path
  ORDER BY mtime DESC NULLS LAST, duration DESC NULLS LAST, fingerprint DESC NULLS LAST) rn
  FROM fingerprint_cache WHERE path IS NOT NULL) WHERE rn = 1)"""
LIBRARY = f"""{LATEST},
lastscan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scan_ord DESC) rn FROM audio_file WHERE path IS NOT NULL) WHERE rn = 1),
lib AS (SELECT s.path, coalesce(s.size, 0) size,
  CASE WHEN coalesce(s.duration, 0) = 0 AND coalesce(c.duration, 0) <> 0 THEN c.duration ELSE coalesce(s.duration, 0) END duration,
  coalesce(s.bitrate, 0) bitrate, s.tags, coalesce(s.fingerprint, c.fingerprint) fp, s.scan_ord
  FROM lastscan s LEFT JOIN latest c ON s.path = c.path)"""
VIEWS = "(VALUES (0::BIGINT, 4294967040::BIGINT), (1, 4294902015), (2, 4278255615), (3, 16777215)) w(v, m)"


def terms_of(source: str, fp: str) -> str:
    return f"(SELECT DISTINCT path, (w.v << 32) | ((x::BIGINT & 4294967295) & w.m) term FROM (SELECT path, unnest({fp}) x FROM {source}), {VIEWS} WHERE x IS NOT NULL)"


POSTS = f"{LIBRARY}, posts AS {terms_of('lib', 'fp')}"
SHARED = """
capped AS (SELECT p.* FROM posts p JOIN (SELECT term FROM posts GROUP BY term HAVING count(*) <= 2000) USING (term)),
shared AS (SELECT x.path a, y.path b, count(*) shared FROM capped x JOIN capped y ON x.term = y.term AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 20)"""
CANDIDATES = f"""{POSTS}, {SHARED},
tc AS (SELECT path, count(*) n FROM posts GROUP BY path),
cand AS (SELECT a, b, shared, ta.n terms_a, tb.n terms_b FROM shared JOIN tc ta ON ta.path = a JOIN tc tb ON tb.path = b
  WHERE shared >= greatest(20, ceil(0.1::DOUBLE * least(ta.n, tb.n))))"""
STORED = """
sedge AS (SELECT least(a, b) a, greatest(a, b) b, max(similarity) similarity, max(tag_score) tag_score, max(duration_delta) duration_delta
  FROM edge WHERE a <> b AND similarity >= 0.85 GROUP BY 1, 2)"""
COMPONENTS = f"""{STORED},
links AS (SELECT a x, b y FROM sedge UNION SELECT b, a FROM sedge),
reach AS (SELECT x, x y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x node, min(y) component FROM reach GROUP BY x)"""
GROUPS = f"""{COMPONENTS},
grp AS (SELECT component "group", count(*) n_files FROM comp GROUP BY 1),
facts AS (SELECT component "group", avg(similarity) s, avg(tag_score) t, max(duration_delta) d FROM sedge JOIN comp ON a = node GROUP BY 1),
groups_ AS (SELECT g."group", n_files, coalesce(s, 1) score, coalesce(t, 0) tag_score, CASE WHEN coalesce(d, 0) <= 5 THEN 'high' ELSE 'medium' END confidence
  FROM grp g LEFT JOIN facts f ON g."group" = f."group")"""
KEEP_ORDER = "CASE WHEN bitrate > 0 THEN bitrate::DOUBLE ELSE coalesce(size, 0)::DOUBLE END DESC, scan_ord"
MEMBERS = f"""{GROUPS}, {LIBRARY.strip()},
members AS (SELECT component "group", lib.* FROM comp JOIN lib ON node = path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY {KEEP_ORDER}) rn, row_number() OVER (PARTITION BY "group" ORDER BY scan_ord) so FROM members),
kept AS (SELECT "group", max(path) FILTER (rn = 1) keep, sum(size)::BIGINT - max(size) FILTER (rn = 1) savings, count(*) n_files FROM ranked GROUP BY 1)"""
ROWS = f"""{MEMBERS},
label AS (SELECT "group", (CASE WHEN coalesce(tags.title, '') <> '' THEN '"' || tags.title || '"' ELSE regexp_extract(path, '([^/]*)$', 1) END)
  || (CASE WHEN coalesce(tags.artist, '') <> '' THEN ' – ' || tags.artist ELSE '' END) label, duration, scan_ord FROM ranked WHERE so = 1),
rows_ AS (SELECT g."group", confidence, row_number() OVER (PARTITION BY confidence ORDER BY scan_ord)::INT number,
  (floor(duration)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(duration)::BIGINT % 60)::VARCHAR, 2, '0') length,
  CASE WHEN tag_score >= 0.5 THEN 'tags/filenames agree' ELSE 'fingerprint only — tags/filenames differ' END note, keep, savings, label
  FROM groups_ g JOIN kept k ON g."group" = k."group" JOIN label l ON g."group" = l."group")"""


def at_offset(a: str, b: str, k: str) -> str:
    """Similarity when k frames (k >= 0) of the first are skipped; for a shift of the other the arguments are swapped."""
    n = f"least(len({a}) - ({k}), len({b}))"
    diff = f"list_sum(list_transform(range(1, ({n}) + 1), lambda i: bit_count(xor({a}[i + ({k})]::BIGINT, {b}[i]::BIGINT) & 4294967295)::BIGINT))::DOUBLE"
    return f"(CASE WHEN {n} > 0 THEN 1.0::DOUBLE - {diff} / (({n}) * 32.0::DOUBLE) ELSE 0.0::DOUBLE END)"


def similarity(source: str, threshold: float = 0.85) -> str:
    return f"""sims AS (SELECT a, b, {at_offset('fa', 'fb', '0')} z,
  list_transform(range(1, 21), lambda k: greatest({at_offset('fa', 'fb', 'k')}, {at_offset('fb', 'fa', 'k')})) s FROM {source}),
scored AS (SELECT a, b, CASE WHEN z >= {threshold} THEN z ELSE coalesce(list_filter(s, lambda x: x >= {threshold})[1], greatest(z, list_max(s))) END similarity FROM sims)"""


PAIRED = f"""{LIBRARY},
ee AS (SELECT DISTINCT least(a, b) a, greatest(a, b) b FROM edge WHERE a <> b),
paired AS (SELECT a, b, x.fp fa, y.fp fb, x.tags ta, y.tags tb FROM ee JOIN lib x ON x.path = a AND len(x.fp) > 0 JOIN lib y ON y.path = b AND len(y.fp) > 0)"""
FOUND = f"""{CANDIDATES},
both_ AS (SELECT a, b, x.fp fa, y.fp fb FROM cand JOIN lib x ON x.path = a JOIN lib y ON y.path = b), {similarity('both_')}"""


def norm(s: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({s}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def norm_artist(s: str) -> str:
    return norm(rf"regexp_replace(coalesce({s}, ''), '\s+(feat\.?|ft\.?|featuring)\s+.*$', '', 'i')")


def norm_stem(p: str) -> str:
    stem = rf"regexp_replace(regexp_extract(coalesce({p}, ''), '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
    bare = rf"regexp_replace(regexp_replace({stem}, '{TRACK_PREFIX}', ''), '[\s_\-]+(\(\d+\)|\[\d+\]|copy|duplicate|\d+)$', '', 'i')"
    return rf"regexp_replace(lower({bare}), '^\s+|\s+$', '', 'g')"


def tag_key(tags: str) -> str:
    t, a = norm(f"{tags}.title"), norm_artist(f"{tags}.artist")
    return f"CASE WHEN {t} <> '' AND {a} <> '' THEN {t} || ' ' || {a} END"


def token_sorted(s: str) -> str:
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array({s}, '\s+'), lambda w: w <> '')), ' ')"


SIZE_TEXT = "(CASE WHEN m.size >= 1048576 THEN printf('%.1f MB', m.size / 1048576.0::DOUBLE) ELSE printf('%.0f KB', m.size / 1024.0::DOUBLE) END)"
RATIOS = f"""
texts AS (SELECT a, b, {token_sorted(norm_stem('a'))} x, {token_sorted(norm_stem('b'))} y FROM paired
  UNION ALL SELECT a, b, {token_sorted('ka')}, {token_sorted('kb')} FROM (SELECT a, b, {tag_key('ta')} ka, {tag_key('tb')} kb FROM paired) WHERE ka IS NOT NULL AND kb IS NOT NULL),
pairs_ AS (SELECT DISTINCT x, y FROM texts),
lcs AS (SELECT x, y, 0 i, list_transform(range(0, length(y) + 1), lambda j: 0) r FROM pairs_
  UNION ALL SELECT x, y, i + 1, list_prepend(0, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(r[k + 1], CASE WHEN substr(y, k, 1) = substr(x, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))) FROM lcs WHERE i < length(x)),
ratio AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100.0 ELSE 200.0 * r[-1] / (length(x) + length(y)) END v FROM lcs WHERE i = length(x)),
tagged AS (SELECT a, b, max(v) score FROM texts JOIN ratio USING (x, y) GROUP BY 1, 2)"""

PLAN = f"""
f AS (SELECT group_id, unnest(files) f FROM duplicate_group),
g AS (SELECT group_id, f.path path, f.size size, f.bitrate bitrate, f.scan_ord scan_ord, row_number() OVER (PARTITION BY group_id, f.path ORDER BY f.scan_ord DESC) rn FROM f),
m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {KEEP_ORDER}) k FROM g WHERE rn = 1),
kk AS (SELECT group_id, path keep FROM m WHERE k = 1),
plan AS (SELECT m.path, keep, CASE WHEN ik.path IS NULL THEN 'keep file missing' WHEN ip.path IS NULL THEN 'already gone' END reason
  FROM m JOIN kk USING (group_id) LEFT JOIN indexed_file ik ON ik.path = keep LEFT JOIN indexed_file ip ON ip.path = m.path WHERE m.path <> keep)"""
HOT = """
v AS (SELECT term, file_id FROM posting WHERE term IS NOT NULL AND file_id IS NOT NULL),
hot AS (SELECT term, count(*) n FROM v GROUP BY term HAVING count(*) >= 0.01 * (SELECT count(*) FROM v))"""


def oracle_sql() -> dict[str, str]:
    with_, rec = "WITH", "WITH RECURSIVE"
    return {
        "scan_min_size": f"SELECT path, size, scan_ord FROM audio_file WHERE regexp_matches(path, '\\.({'|'.join(AUDIO_SUFFIXES)})$', 'i') AND size >= 102400",
        "coerced_info": r"SELECT scan_ord, coalesce(duration, 0.0) duration, coalesce(bitrate, 0) bitrate, coalesce(regexp_replace(tags.title, '^\s+|\s+$', '', 'g'), '') title, coalesce(regexp_replace(tags.artist, '^\s+|\s+$', '', 'g'), '') artist FROM audio_file",
        "signed32": f"{with_} {LATEST}, u AS (SELECT path, unnest(fingerprint)::BIGINT & 4294967295 AS unsigned, (unnest(range(len(fingerprint))))::INT pos FROM latest) SELECT path, pos, unsigned, (CASE WHEN unsigned >= 2147483648 THEN unsigned - 4294967296 ELSE unsigned END)::INT AS signed FROM u",
        "cache_freshness_split": f"""{with_} {LATEST}, j AS (SELECT i.id, i.path, coalesce(abs(c.mtime - i.mtime) < 1.0, false) hit, i.duration di, c.duration dc, c.fingerprint fp FROM incoming_file i LEFT JOIN latest c ON i.path = c.path)
            SELECT id, path, hit, CASE WHEN hit AND coalesce(di, 0) = 0 AND coalesce(dc, 0) <> 0 THEN dc ELSE di END duration, CASE WHEN hit THEN coalesce(len(fp), 0)::INT END frames FROM j""",
        "cache_progress": f"{with_} {LATEST} SELECT batch_no, count(*) FILTER (coalesce(abs(c.mtime - i.mtime) < 1.0, false)) cached, count(*) FILTER (NOT coalesce(abs(c.mtime - i.mtime) < 1.0, false)) to_compute FROM incoming_file i LEFT JOIN latest c ON i.path = c.path GROUP BY 1",
        "cache_upsert": f"""{with_} {LATEST}, new AS (SELECT * FROM (SELECT path, mtime, duration, fingerprint, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, duration DESC NULLS LAST, fingerprint DESC NULLS LAST) rn FROM incoming_file WHERE path IS NOT NULL) WHERE rn = 1)
            SELECT path, mtime, duration, len(fingerprint)::INT frames FROM latest WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, mtime, duration, len(fingerprint)::INT FROM new""",
        "backfill_missing": f"{with_} {LATEST}, gap AS (SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM indexed_file i WHERE i.path = l.path)) SELECT path, term FROM {terms_of('gap', 'fingerprint')}",
        "eligible": f"{with_} {LIBRARY} SELECT path, len(fp)::INT frames FROM lib WHERE len(fp) > 0",
        "cache_count": "SELECT count(DISTINCT path) n FROM fingerprint_cache",
        "term_postings": f"{with_} {POSTS} SELECT path, term FROM posts",
        "term_counts": f"{with_} {POSTS} SELECT path, count(*) term_count FROM posts GROUP BY path",
        "document_frequency": f"{with_} {POSTS} SELECT term, count(*) df FROM posts GROUP BY term",
        "df_capped_postings": f"{with_} {POSTS} SELECT path, term, df FROM posts JOIN (SELECT term, count(*) df FROM posts GROUP BY term HAVING count(*) <= 20) USING (term)",
        "df_capped_postings_default": f"{with_} {POSTS} SELECT path, term, df FROM posts JOIN (SELECT term, count(*) df FROM posts GROUP BY term HAVING count(*) <= 2000) USING (term)",
        "shared_terms": f"{with_} {POSTS}, {SHARED} SELECT a, b, shared FROM shared",
        "candidate_pairs": f"{with_} {CANDIDATES} SELECT a, b, shared, terms_a, terms_b FROM cand",
        "candidates_of_posting": f"{with_} posts AS (SELECT DISTINCT i.path, p.term FROM posting p JOIN indexed_file i ON p.file_id = i.id WHERE p.term IS NOT NULL), {SHARED} SELECT a, b, shared FROM shared JOIN indexed_file x ON x.path = a JOIN indexed_file y ON y.path = b WHERE shared >= greatest(20, ceil(0.1::DOUBLE * least(coalesce(x.term_count, 0), coalesce(y.term_count, 0))))",
        "find_candidates": f"""{with_} posts AS (SELECT DISTINCT i.path, i.id, p.term FROM posting p JOIN indexed_file i ON p.file_id = i.id WHERE p.term IS NOT NULL),
            n AS (SELECT path, count(*) term_count FROM posts GROUP BY 1), rare AS (SELECT term FROM posts GROUP BY 1 HAVING count(*) <= 2000)
            SELECT q.path, c.path candidate, count(*) shared, any_value(term_count) term_count FROM posts q JOIN rare USING (term) JOIN posts c USING (term) JOIN n ON n.path = c.path
            WHERE q.id % 50 = 0 AND c.path > q.path GROUP BY 1, 2 HAVING count(*) >= 20""",
        "shared_terms_in_cache_scope": f"""{with_} {LATEST}, new AS (SELECT path, fingerprint fp FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, duration DESC NULLS LAST, fingerprint DESC NULLS LAST) rn FROM incoming_file WHERE path IS NOT NULL) WHERE rn = 1),
            everything AS (SELECT * FROM new UNION ALL SELECT path, fingerprint FROM latest WHERE path NOT IN (SELECT path FROM new)),
            posts AS {terms_of('new', 'fp')}, wide AS {terms_of('everything', 'fp')}, capped AS (SELECT p.* FROM posts p JOIN (SELECT term FROM wide GROUP BY 1 HAVING count(*) <= 60) USING (term))
            SELECT x.path a, y.path b, count(*) shared FROM capped x JOIN capped y ON x.term = y.term AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 20""",
        "cache_force_refresh": "SELECT id, false hit, duration FROM incoming_file",
        "report_files": f"""{rec} {ROWS} SELECT confidence, number, (row_number() OVER (PARTITION BY m."group" ORDER BY m.size DESC, m.scan_ord))::INT place, m.path, {SIZE_TEXT} size_text, m.path = r.keep kept
            FROM members m JOIN rows_ r ON m."group" = r."group" """,
        "json_encoded": f"""{rec} {MEMBERS}, fl AS (SELECT "group", list(path ORDER BY scan_ord) files FROM members GROUP BY 1)
            SELECT keep, to_json({{'tier': 'fingerprint', 'confidence': confidence, 'files': files, 'keep': keep}})::VARCHAR json FROM groups_ g JOIN kept k ON g."group" = k."group" JOIN fl ON fl."group" = g."group" """,
        "hamming_at_offset": f"{with_} {PAIRED} SELECT a, b, round({at_offset('fa', 'fb', '0')}, 9) s0, round({at_offset('fa', 'fb', '5')}, 9) s5, round({at_offset('fb', 'fa', '5')}, 9) s_5 FROM paired",
        "fingerprint_similarity": f"{with_} {PAIRED}, {similarity('paired')} SELECT a, b, round(similarity, 9) similarity FROM scored",
        "normalize_title": f"SELECT scan_ord, {norm('tags.title')} norm FROM audio_file",
        "normalize_artist": f"SELECT scan_ord, {norm_artist('tags.artist')} norm FROM audio_file",
        "normalize_stem": f"SELECT scan_ord, {norm_stem('path')} norm FROM audio_file",
        "identity_score": f"{rec} {PAIRED}, {RATIOS} SELECT a, b, round(score::DOUBLE, 6) score FROM tagged",
        "edges": f"{with_} {FOUND} SELECT a, b, round(similarity, 9) similarity, round(abs(x.duration - y.duration), 6) duration_delta FROM scored JOIN lib x ON x.path = a JOIN lib y ON y.path = b WHERE similarity >= 0.85",
        "components": f"{rec} {COMPONENTS} SELECT node, component FROM comp",
        "duplicate_groups": f'{rec} {GROUPS} SELECT "group", n_files, round(score, 6) score, round(tag_score, 6) tag_score, confidence FROM groups_',
        "keep_best": f'{rec} {MEMBERS} SELECT "group", keep, savings, n_files FROM kept',
        "report_rows": f"{rec} {ROWS} SELECT * FROM rows_",
        "report_summary": f"{rec} {ROWS} SELECT (SELECT count(*) FROM lib) n_scanned, count(*) n_groups, count(*) FILTER (confidence = 'high') n_high, count(*) FILTER (confidence = 'medium') n_medium, coalesce(sum(savings), 0)::BIGINT savings FROM rows_",
        "json_report": f"""{rec} {MEMBERS}, fl AS (SELECT "group", string_agg(path, chr(10) ORDER BY scan_ord) files FROM members GROUP BY 1)
            SELECT 'fingerprint' tier, confidence, round(round(score, 9), 4) score, round(round(tag_score, 9), 4) tag_score, files, keep FROM groups_ g JOIN kept k ON g."group" = k."group" JOIN fl ON fl."group" = g."group" """,
        "apply_plan": f"{with_} {PLAN} SELECT path, keep, CASE WHEN reason IS NULL THEN 'done' ELSE 'skip' END status, reason FROM plan",
        "apply_counts": f"{with_} {PLAN} SELECT CASE WHEN reason IS NULL THEN 'done' ELSE 'skip' END status, count(*) n FROM plan GROUP BY 1",
        "detected_edges": f"""{rec} {FOUND}, paired AS (SELECT a, b, x.tags ta, y.tags tb FROM scored JOIN lib x ON x.path = a JOIN lib y ON y.path = b WHERE similarity >= 0.85), {RATIOS}
            SELECT a, b, round(similarity, 6) similarity, round((score / 100)::DOUBLE, 6) tag_score FROM scored JOIN tagged USING (a, b) WHERE similarity >= 0.85""",
        "detected_groups": f"""{rec} {FOUND}, paired AS (SELECT a, b, x.tags ta, y.tags tb FROM scored JOIN lib x ON x.path = a JOIN lib y ON y.path = b WHERE similarity >= 0.85), {RATIOS},
            edge AS (SELECT a, b, similarity, score / 100 tag_score, abs(x.duration - y.duration) duration_delta FROM scored JOIN tagged USING (a, b) JOIN lib x ON x.path = a JOIN lib y ON y.path = b WHERE similarity >= 0.85),
            {GROUPS} SELECT "group", n_files, round(score::DOUBLE, 6) score, round(tag_score::DOUBLE, 6) tag_score, confidence FROM groups_""",
        "p5_found": f"{with_} {HOT}, c AS (SELECT term, file_id, count(*) n FROM v JOIN hot USING (term) GROUP BY 1, 2) SELECT term, file_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, file_id) rn FROM c) WHERE rn = 1",
        "p5_quantiles": f"""{with_} {HOT}, r AS (SELECT v.term, file_id, row_number() OVER (PARTITION BY v.term ORDER BY file_id) rn, n FROM v JOIN hot ON v.term = hot.term)
            SELECT term, q AS quantile, file_id FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.75)) qs(q) WHERE rn = greatest(1, ceil(q * n - 1e-9))""",
    }
