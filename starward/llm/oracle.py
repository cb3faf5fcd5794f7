"""Expected results of the operators as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

#: Removes every word that a 13-word window covers whose words also start in a smaller document.
CUT_REPEATS = r"""
WITH lists AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS words
    FROM lists, unnest(range(1, len(words) - 11)) AS starts(pos)
), owners AS (
    SELECT words, min(doc_id) AS first_doc FROM windows GROUP BY words
), removed AS (
    SELECT DISTINCT doc_id, pos + step AS pos
    FROM windows JOIN owners USING (words), unnest(range(0, 13)) AS steps(step)
    WHERE first_doc < doc_id
), gone AS (
    SELECT doc_id, list(pos) AS places FROM removed GROUP BY doc_id
), marked AS (
    SELECT doc_id, words, coalesce(places, []::BIGINT[]) AS places FROM lists LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda w, pos: NOT list_contains(places, pos)), ' ')) AS kept_sha256
FROM marked
"""

#: Links documents with 100 * common >= 85 * union of 3-word shingles, then spreads the least id.
NEAR_DUPLICATES = r"""
WITH RECURSIVE lists AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 2], ' ') AS shingle
    FROM lists, unnest(range(1, greatest(len(words) - 1, 2))) AS starts(pos)
    WHERE len(words) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT b, seen FROM reach JOIN links ON node = a
), roots AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN roots ON node = doc_id LEFT JOIN sizes USING (doc_id)
"""

#: Links vectors with a cosine of 0.9 or more, then spreads the least id.
EMBEDDING_DUPLICATES = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_dot_product(v, v) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach AS (
    SELECT vec_id AS node, vec_id AS seen FROM embeddings
    UNION
    SELECT b, seen FROM reach JOIN links ON node = a
), roots AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

#: The damage done to the copy. A record has 269 bytes besides the url, the body and
#: the digits of the length of its payload (the body and 44 bytes).
WARC_AUDIT = """
WITH records AS (
    SELECT page_id, page_id % 211 = 7 AS lost, page_id % 101 = 0 AS damaged,
           strlen(coalesce(url, '')) + strlen(coalesce(html, '')) AS bytes,
           len((strlen(coalesce(html, '')) + 44)::VARCHAR) AS digits
    FROM pages
)
SELECT page_id, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status,
       (269 + bytes + digits)::BIGINT AS length,
       CASE WHEN NOT lost THEN (269 + bytes + digits)::BIGINT END AS found_length
FROM records WHERE lost OR damaged
"""

#: Counts words after the planted deletions (crc32 by half bytes, from the table of its 16
#: remainders), finds near words by equal shortened forms, and follows forms to the last.
SPELLING = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), plain AS (
    SELECT doc_id::VARCHAR AS id, count(*) AS n,
           translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM runs WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
    SELECT run, n, id IS NULL AS kept, hex(encode(coalesce(id, '') || ':' || run)) AS code FROM plain
), halves AS (
    SELECT run, n, kept, list_transform(range(0, len(code)),
        lambda i: instr('0123456789ABCDEF', code[(i // 2) * 2 + 2 - i % 2]) - 1) AS half
    FROM coded
), hashed AS (
    SELECT run, n, kept, xor(4294967295, list_reduce(list_prepend(4294967295, half), lambda crc, x: xor(crc >> 4,
        [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
         3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(crc, x) & 15) + 1]))) AS h
    FROM halves
), edited AS (
    SELECT n, CASE WHEN h % 31 = 0 AND NOT kept
        THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest
    FROM words, unnest(range(1, length(word) + 1)) AS places(pos)
), near AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
    UNION SELECT cut.word, words.word FROM cut JOIN words ON rest = words.word
    UNION SELECT words.word, cut.word FROM cut JOIN words ON rest = words.word
), ranked AS (
    SELECT a, b, words.n AS n_b, count(*) OVER (PARTITION BY a) AS n_near,
           row_number() OVER (PARTITION BY a ORDER BY words.n DESC, b) AS place
    FROM near JOIN words ON b = words.word
), forms AS (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN n_b >= 10 * n THEN b END AS form,
           CASE WHEN n_b >= 10 * n THEN n_b END AS form_n
    FROM words LEFT JOIN ranked ON a = word AND place = 1
), paths AS (
    SELECT word, form AS root FROM forms WHERE form IS NOT NULL
    UNION ALL
    SELECT paths.word, forms.form FROM paths JOIN forms ON paths.root = forms.word WHERE forms.form IS NOT NULL
), roots AS (
    SELECT paths.word, root FROM paths JOIN forms ON root = forms.word WHERE form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""

#: All phrases of pieces are counted, cut at every place and scored by the lowest cut.
COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
    SELECT lang, words[pos:pos + size - 1] AS phrase, count(*) AS n
    FROM lists, unnest(range(1, len(words) + 1)) AS places(pos), unnest(range(1, 6)) AS sizes(size)
    WHERE pos + size - 1 <= len(words)
    GROUP BY ALL HAVING count(*) >= 100
), totals AS (
    SELECT lang, sum(len(words))::HUGEINT AS n FROM lists GROUP BY lang
), cuts AS (
    SELECT g.lang, g.phrase, g.n AS a, k, x.n AS l, y.n AS r, totals.n AS n,
           (1000::HUGEINT * g.n * totals.n) // (x.n::HUGEINT * y.n) AS score
    FROM grams g, unnest(range(1, len(g.phrase))) AS places(k)
    JOIN grams x ON x.lang = g.lang AND x.phrase = g.phrase[1:k]
    JOIN grams y ON y.lang = g.lang AND y.phrase = g.phrase[k + 1:]
    JOIN totals ON totals.lang = g.lang
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, phrase[pos:pos + size - 1] AS phrase, max(n) AS longer
    FROM grams, unnest(range(2, 5)) AS sizes(size), unnest(range(1, 5)) AS places(pos)
    WHERE size < len(phrase) AND pos + size - 1 <= len(phrase)
    GROUP BY ALL
), kept AS (
    SELECT lowest.* REPLACE (array_to_string(phrase, ' ') AS phrase)
    FROM lowest LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op3_embedding_duplicates": EMBEDDING_DUPLICATES,
    "op5_warc_audit": WARC_AUDIT,
    "op7_cut_repeats": CUT_REPEATS,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op11_spelling_variants": SPELLING,
    "op12_collocations": COLLOCATIONS,
}
