"""The registered queries of this subpackage: each applies one operator to a whole table and derives digests of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import bpe, compact_windows, embedding_dedup, language, minhash, packing, quality, secrets, sharding, spelling, suffix_dedup, toxicity, whitening
from lodestar.llm.common import documents, tokenizer_file


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``: links at 0.98 within a label. Unusable vectors stand alone; no row is left out."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: learned on three folds of four, predicted on each whole text; null texts and texts without letters are ``und``."""
    docs = documents(spark, sf_dir)
    model = language.train(docs, language.in_training())
    return language.predict(docs, model).select("doc_id", (language.doc_fold() == 2).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: spans of the fixed patterns and of the models, as counts, a digest and a list; null texts have none."""
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("markov"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near-equal bytes; null texts weigh 16 bytes."""
    rows, _ = sharding.shard(documents(spark, sf_dir), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: bytes that an earlier 100-byte string covers are taken out; null texts have none."""
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents: ids and decoded texts as digests; null texts have no ids and an empty text."""
    path = path or tokenizer_file("byte_bpe_50k.json")
    both = bpe.round_trip(documents(spark, sf_dir), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: statistics of whole texts and the verdict of the line rules; null texts have no words."""
    return quality.clean_lines(documents(spark, sf_dir)).drop("clean_text")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents as pieces in windows of 4096 tokens; a null text is its end id alone."""
    return packing.pack_documents(documents(spark, sf_dir), path or tokenizer_file("word_bpe_49k.json"), end_id=2)


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: passages of 50 words or more that repeat one of an earlier document; null texts have none."""
    return compact_windows.near_duplicate_passages(documents(spark, sf_dir))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: sets of 3-word shingles, linked from 85 per cent on; texts without words link with nothing."""
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: learned from the labels of three folds of four, scored on each whole text; null texts count as empty."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), language.in_training())
    found = toxicity.score(docs, model)
    return found.select("doc_id", (language.doc_fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: words of whole texts, one run in 97 with a letter left out, their forms and roots; null texts have none."""
    return spelling.variants(documents(spark, sf_dir), spelling.TYPO)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings`` on the 32 leading components; null and non-finite vectors are left out."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE ok AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach AS (
    SELECT DISTINCT a AS id, a AS r FROM links
    UNION
    SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
    coalesce((SELECT min(r) FROM reach WHERE id = e.vec_id), e.vec_id) AS component_id,
    coalesce((SELECT min(r) FROM reach WHERE id = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
    SELECT DISTINCT a AS id, a AS r FROM pairs
    UNION
    SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
least_id AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least_id ON id = doc_id
"""

OP4_SQL = """
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
made AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 8192 AS vslot,
        xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::UBIGINT)),
            lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])))::BIGINT AS text_crc32
    FROM documents, crc),
slots AS (SELECT vslot, sum(size)::BIGINT AS b, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, vslot) AS i FROM made GROUP BY vslot),
placed AS (
    SELECT 0::BIGINT AS i, 0::BIGINT AS vslot, 0::BIGINT AS shard, list_transform(range(40), lambda x: 0::BIGINT) AS loads
    UNION ALL
    SELECT s.i, s.vslot, list_position(p.loads, list_min(p.loads)) - 1,
        list_transform(p.loads, lambda v, k: CASE WHEN k = list_position(p.loads, list_min(p.loads)) THEN v + s.b ELSE v END)
    FROM placed p JOIN slots s ON s.i = p.i + 1),
map AS (
    SELECT placed.vslot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY placed.vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM placed JOIN slots ON slots.vslot = placed.vslot WHERE placed.i > 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, (first + row_number() OVER (PARTITION BY made.vslot ORDER BY doc_id, size, text_crc32) - 1)::BIGINT AS slot,
    NULL::INT AS grown_shard, made.vslot::INT AS vslot
FROM made JOIN map ON map.vslot = made.vslot
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS b, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
marked AS (
    SELECT bytes.*, coalesce(p - max(CASE WHEN again.p IS NOT NULL THEN bytes.p END) OVER (PARTITION BY doc_id ORDER BY p) < 100, false) AS gone
    FROM bytes LEFT JOIN again USING (doc_id, p)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM marked),
sums AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), '') AS kept
    FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
own AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
judged AS (
    SELECT doc_id, i, line, words, length(array_to_string(words, '')) AS chars,
        2 * length(regexp_replace(bare, '[^\p{L}]', '', 'g')) < length(array_to_string(words, ''))
        OR (len(words) < 4 AND NOT regexp_matches(bare, '[.!?…:;"''»”’)\]]$'))
        OR regexp_full_match(bare, '(?i)(?:home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back to top|read more|share|subscribe|skip to content|site map|sitemap|faq|help|accueil|connexion|se connecter|s''inscrire|inscription|recherche|rechercher|contactez-nous|à propos|suivant|précédent|retour en haut|haut de page|lire la suite|partager|s''abonner|plan du site|aide|inicio|menú|iniciar sesión|registrarse|buscar|contacto|acerca de|siguiente|anterior|volver arriba|leer más|compartir|suscribirse|mapa del sitio|ayuda|startseite|menü|anmelden|registrieren|suche|suchen|kontakt|über uns|weiter|zurück|nach oben|mehr lesen|weiterlesen|teilen|abonnieren|inhaltsverzeichnis|hilfe|impressum)')
        OR len(list_filter(words, lambda w: w IN ('|', '»', '›', '>', '·', '•', '::', '/'))) >= 3
        OR regexp_matches(bare, '(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|uses cookies|accept (?:all )?cookies|enable javascript|lorem ipsum|click here|copyright [0-9]{4}|subscribe to our newsletter|tous droits réservés|politique de confidentialité|conditions d''utilisation|utilise des cookies|accepter (?:tous )?les cookies|cliquez ici|mentions légales|todos los derechos reservados|política de privacidad|términos (?:de uso|y condiciones)|utiliza cookies|aceptar (?:todas )?las cookies|haga clic aquí|aviso legal|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|verwendet cookies|(?:alle )?cookies akzeptieren|hier klicken|newsletter abonnieren') AS fails,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
    FROM own WHERE len(words) > 0),
by_line AS (
    SELECT doc_id, sum(chars) FILTER (fails) AS lost, count(*) FILTER (nth > 1) AS n_dup FROM judged GROUP BY doc_id),
tokens AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM tokens),
windows AS (
    SELECT doc_id, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT *, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS rep FROM windows),
covered AS (
    SELECT doc_id, rep OR coalesce(lag(rep) OVER o, false) OR coalesce(lag(rep, 2) OVER o, false) AS hit
    FROM twice WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM covered GROUP BY doc_id),
stats AS (
    SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars
    FROM tokens t LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= word_chars AS kept,
    CAST(lost_chars AS BIGINT) AS lost_chars
FROM stats
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
found AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
runs AS (SELECT doc_id, r, count(*) AS c FROM found WHERE length(r) >= 5 GROUP BY ALL),
hashed AS (
    SELECT r, c, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..'), lambda b: ('0x' || b)::UBIGINT)),
        lambda v, b: xor(v >> 8, t[((xor(v, b) & 255) + 1)::BIGINT])))::BIGINT AS h FROM runs, crc),
words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(c)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON words.word = cut
    UNION
    SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON words.word = cut),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, n AS other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS (SELECT words.word, other, other_n FROM words JOIN best ON best.word = words.word WHERE other_n >= 2 * n),
walk AS (
    SELECT word, other AS here, 1 AS step FROM forms
    UNION ALL
    SELECT walk.word, forms.other, step + 1 FROM walk JOIN forms ON forms.word = here),
ends AS (SELECT word, max_by(here, step) AS root FROM walk GROUP BY word)
SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, other AS form, other_n AS form_n, coalesce(root, words.word) AS root
FROM words LEFT JOIN counted ON counted.word = words.word LEFT JOIN forms ON forms.word = words.word LEFT JOIN ends ON ends.word = words.word
"""

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_virtual_slots": op4_virtual_slots,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_compact_windows": op9_compact_windows,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op1_embedding_dedup": OP1_SQL, "op4_virtual_slots": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op7_quality_rules": OP7_SQL, "op10_minhash_dedup": OP10_SQL, "op12_spelling_variants": OP12_SQL}
