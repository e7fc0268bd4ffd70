"""The corpus queries that SQL can state, as DuckDB statements over the same tables."""

from __future__ import annotations

from cuewise.llm.licenses import BLOCK, PHRASES, SHARE, STRIDE, TEMPLATES, template_table

WORD = r"[^\x20\x09-\x0D]+"
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_TOP_K = """
WITH vectors AS (
  SELECT DISTINCT vec_id, [floor(256.0::DOUBLE * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, max(CAST(list_inner_product(q.v, d.v) AS BIGINT)) AS score
  FROM vectors q JOIN vectors d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, d.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

FOLLOWING = ", ".join(f"lead(word, {k}) OVER run" for k in range(1, 20))
REPEATED_PASSAGES = f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), spots AS MATERIALIZED (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts
), windows AS MATERIALIZED (
  SELECT doc_id, pos, md5(concat_ws(' ', word, {FOLLOWING})) AS run, lead(word, 19) OVER run IS NOT NULL AS whole
  FROM spots WINDOW run AS (PARTITION BY doc_id ORDER BY pos)
), repeated AS MATERIALIZED (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS gone FROM windows WHERE whole
), judged AS (
  SELECT s.doc_id, s.pos, s.word,
         max(coalesce(r.gone, false)) OVER (PARTITION BY s.doc_id ORDER BY s.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM spots s LEFT JOIN repeated r ON s.doc_id = r.doc_id AND s.pos = r.pos
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS rest
  FROM judged GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


def license_scan() -> str:
    """Phrases by neighbouring words; templates by the share of their words in each block, without any filter before."""
    templates = [(t, label, words, need) for t, label, words, need in template_table(TEMPLATES, {}, SHARE)]
    table = ", ".join(f"({t}, '{label}', '{w}', {need}, {len(words)})" for t, label, words, need in templates for w in words)
    tests = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM followed WHERE " + " AND ".join(f"w{k} = '{word}'" for k, word in enumerate(phrase))
        for label, phrase in PHRASES)
    return f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LICENSE_WORD}') AS words FROM documents
), spots AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM texts
), followed AS MATERIALIZED (
  SELECT doc_id, pos, word AS w0, lead(word, 1) OVER run AS w1, lead(word, 2) OVER run AS w2
  FROM spots WINDOW run AS (PARTITION BY doc_id ORDER BY pos)
), hits AS ({tests}), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id
), pattern(template, label, word, need, size) AS (VALUES {table}), sizes AS (
  SELECT doc_id, greatest(0, CAST(ceil((len(words) - {BLOCK}) / {STRIDE}.0) AS BIGINT)) AS last_block FROM texts
), blocks AS (
  SELECT DISTINCT s.doc_id, s.pos // {STRIDE} - back AS k, s.word
  FROM spots s JOIN sizes z ON s.doc_id = z.doc_id, range({BLOCK // STRIDE}) b(back)
  WHERE s.word IN (SELECT word FROM pattern) AND s.pos // {STRIDE} - back BETWEEN 0 AND z.last_block
), shares AS (
  SELECT b.doc_id, p.label, count(*) AS shared, p.size FROM blocks b JOIN pattern p ON b.word = p.word
  GROUP BY b.doc_id, b.k, p.template, p.label, p.need, p.size HAVING count(*) >= p.need
), met AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(shared AS DOUBLE) / size) AS best FROM shares GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.best, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN base b ON t.doc_id = b.doc_id LEFT JOIN met m ON t.doc_id = m.doc_id
"""


def merkle_manifest(levels: int = 8) -> str:
    """Level by level over all nodes of a tree; ``levels`` of runs of 8 suffice for 8^levels rows."""
    def field(name: str, column: str | None = None) -> str:
        value = column or f"CAST({name} AS VARCHAR)"
        return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"

    fields = [field(n) for n in ("doc_id", "source", "lang", "n_chars")]
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    steps = []

    def climb(name: str) -> None:
        """Tables {name}0.. of (tree, i, digest, left, right, m), each from the runs of the one before."""
        for k in range(levels + 1):
            source = f"{name}_start" if k == 0 else f"""(SELECT tree, CASE WHEN m > 1 THEN i // 8 ELSE i END AS i,
                CASE WHEN any_value(m) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
                FROM {name}{k - 1} GROUP BY tree, CASE WHEN m > 1 THEN i // 8 ELSE i END, m)"""
            run = "PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
            steps.append(f"""{name}{k} AS MATERIALIZED (SELECT tree, i, digest, count(*) OVER (PARTITION BY tree) AS m,
              coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {source})""")

    def walk(name: str, before: str) -> str:
        """Carry (row, tree, i, proof, folded) of ``before`` through the levels of its tree."""
        for k in range(levels):
            steps.append(f"""{name}_walk{k} AS MATERIALIZED (SELECT w.row, w.tree, CASE WHEN n.m > 1 THEN w.i // 8 ELSE w.i END AS i,
              w.proof || CASE WHEN n.m > 1 THEN n.l || n.r ELSE '' END AS proof,
              CASE WHEN n.m > 1 THEN sha256(n.l || w.folded || n.r) ELSE w.folded END AS folded
              FROM {before} w JOIN {name}{k} n ON w.tree = n.tree AND w.i = n.i)""")
            before = f"{name}_walk{k}"
        return before

    steps.append("""crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)""")
    steps.append("""marked AS (SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, a: xor(c >> 8, t[(xor(c, a) & 255) + 1])), 4294967295) % 3 = 0 AS tampered FROM documents d, crc_table)""")
    steps.append(f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('-' || lang, '') AS tree, sha256({' || '.join([*fields, field('text')])}) AS leaf,
      CASE WHEN tampered THEN sha256({' || '.join([*fields, field('text', lowered)])}) END AS changed FROM marked)""")
    steps.append("""rows AS MATERIALIZED (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)""")
    steps.append("leaf_start AS (SELECT tree, i, leaf AS digest FROM rows)")
    climb("leaf")
    steps.append("row_start AS (SELECT row, tree, i, '' AS proof, coalesce(changed, leaf) AS folded FROM rows)")
    climbed = walk("leaf", "row_start")
    steps.append(f"subroots AS MATERIALIZED (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS i FROM leaf{levels})")
    steps.append("tree_start AS (SELECT '' AS tree, i, digest FROM subroots)")
    climb("tree")
    steps.append(f"top_start AS (SELECT w.row, '' AS tree, s.i, w.proof, w.folded FROM {climbed} w JOIN subroots s ON w.tree = s.name)")
    done = walk("tree", "top_start")
    return f"""WITH {', '.join(steps)}
SELECT r.doc_id, r.leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM rows r JOIN {done} w ON r.row = w.row JOIN subroots s ON r.tree = s.name, tree{levels} t"""


ORACLES: dict[str, str] = {
    "op6_license_scan": license_scan(),
    "op7_exact_top_k": EXACT_TOP_K,
    "op10_substring_dedup": REPEATED_PASSAGES,
    "op13_merkle_manifest": merkle_manifest(),
}
