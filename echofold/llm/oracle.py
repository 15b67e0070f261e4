"""The same queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

from echofold.plans.oracle import LATEST, similarity

MEMBER = """
f AS (SELECT group_id, unnest(files) f FROM duplicate_group),
m AS (SELECT group_id, f.path path, arg_max(f.bitrate, f.scan_ord) FILTER (f.bitrate > 0) bitrate, arg_max(f.size, f.scan_ord) FILTER (f.size > 0) size,
  arg_max(f.duration, f.scan_ord) FILTER (f.duration > 0) duration FROM f WHERE f.path IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, coalesce(CASE WHEN bitrate < 8000 THEN bitrate * 1000.0::DOUBLE ELSE bitrate END, size * 8.0::DOUBLE / duration) rate FROM m),
t AS (SELECT group_id, max(rate) top FROM r GROUP BY 1 HAVING count(*) >= 2 AND max(rate) IS NOT NULL)"""
VALID = "v AS (SELECT term, file_id FROM posting WHERE term IS NOT NULL AND file_id IS NOT NULL)"


def last(field: str, known: str) -> str:
    return f"arg_max({field}, f.scan_ord) FILTER ({known})"


def trusted(field: str, known: str) -> str:
    rank = "CASE WHEN regexp_matches(lower(f.path), '\\.(flac|wav|aiff|alac|ape|wv)$') THEN 2 WHEN f.path IS NOT NULL THEN 1 ELSE 0 END"
    return f"(max({{'r': {rank}, 'o': f.scan_ord, 'v': {field}}}) FILTER ({known})).v"


def oracle_sql() -> dict[str, str]:
    fields, by_trust = (", ".join([f"{of(f'f.{n}', f'f.{n} > 0')} {n}" for n in ("bitrate", "size", "duration")] + [f"{of(f'f.tags.{n}', f'''trim(f.tags.{n}) <> '' ''')} {n}" for n in ("title", "artist", "album")]) for of in (last, trusted))
    return {
        "p1_found": f"WITH {MEMBER} SELECT group_id, path keep_path FROM (SELECT r.group_id, path, row_number() OVER (PARTITION BY r.group_id ORDER BY coalesce(size, 0) DESC, path) rn FROM r JOIN t ON r.group_id = t.group_id WHERE rate * 100.0 >= top * 97.0) WHERE rn = 1",
        "p1_golden": f"WITH f AS (SELECT group_id, unnest(files) f FROM duplicate_group) SELECT group_id, {fields} FROM f GROUP BY group_id",
        "p1_golden_by_trust": f"WITH f AS (SELECT group_id, unnest(files) f FROM duplicate_group) SELECT group_id, {by_trust} FROM f GROUP BY group_id",
        "p3_found": f"WITH {VALID}, c AS (SELECT term, count(DISTINCT file_id) n FROM v GROUP BY 1), k AS (SELECT count(DISTINCT file_id) n FROM v) SELECT term, CASE WHEN c.n <= 2 THEN 'rare' ELSE 'common' END mark FROM c, k WHERE c.n <= 2 OR (c.n > 20 AND c.n > 0.05 * k.n)",
        "p3_frequencies": f"WITH {VALID} SELECT term, count(*) occurrences, count(DISTINCT file_id) records FROM v GROUP BY 1",
        "p4_found": "WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM edge WHERE similarity >= 0.85 AND a <> b), l AS (SELECT a x, b y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x path, min(y) group_path FROM r GROUP BY 1",
        # Every pair of a new file and an earlier one, at all shifts.
        "p6_found": f"""WITH {LATEST}, old AS (SELECT id, 0 batch, fingerprint f FROM latest JOIN indexed_file USING (path)), new AS (SELECT id, batch_no batch, fingerprint f FROM incoming_file WHERE len(fingerprint) > 0),
            earlier AS (SELECT * FROM old WHERE len(f) > 0 UNION ALL SELECT * FROM new), both_ AS (SELECT x.id a, y.id b, x.f fa, y.f fb FROM earlier x JOIN new y ON x.batch < y.batch), {similarity('both_')}
            SELECT least(a, b) id_a, greatest(a, b) id_b FROM scored WHERE similarity >= 0.85""",
        "p7_found": f"WITH {VALID}, s AS (SELECT DISTINCT term, file_id FROM v), n AS (SELECT file_id, count(*) n FROM s GROUP BY 1), o AS (SELECT x.file_id a, y.file_id b, count(*) o FROM s x JOIN s y ON x.term = y.term AND x.file_id < y.file_id GROUP BY 1, 2) SELECT a id_a, b id_b FROM o JOIN n p ON p.file_id = a JOIN n q ON q.file_id = b WHERE 3 * o >= p.n + q.n",
    }
