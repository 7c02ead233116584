"""Token rows from documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import records
from ..operators import tokenise as T
from ..operators import vocabulary as V
from ..operators.joins import attach
from .bindings import EXCHANGES_SQL, IDS, WORDS, exchanges, in_batches, mask_rows
from .common import bound, plain, query, table


def ids(column):
    return IDS.format(column)


def text_of(lst):
    return f"array_to_string({lst}, ',')"


TURNS = f"WITH c AS (SELECT conv_id * 100 + turn AS row_id, conv_id // 8 AS batch_id, text, {ids('text')} AS ids FROM conversations), "\
        f"k AS (SELECT *, len(ids) AS n FROM c)"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), F.floor(F.col("conv_id") / 8).alias("batch_id"), "text",
        K.tokenize(F.col("text")).alias("ids"))


def repeat(value, n):
    return f"list_resize(CAST([] AS BIGINT[]), CAST(greatest({n}, 0) AS BIGINT), {value}::BIGINT)"


@query("filter_prompt_length", f"SELECT doc_id, len({WORDS.format('text')}) AS n_tokens FROM documents WHERE len({WORDS.format('text')}) <= 300")
def filter_prompt_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", K.word_tokens(F.col("text")).alias("words"))
    return T.filter_prompt_length(docs, F.col("words"), 300).select("doc_id", F.size("words").cast("bigint").alias("n_tokens"))


@query("flag_overlong_prompts", TURNS + " SELECT row_id, max(n) OVER (PARTITION BY batch_id) AS padded_length, CASE WHEN max(n) OVER (PARTITION BY batch_id) > 150 THEN 1 ELSE 0 END AS overlong FROM k")
def flag_overlong_prompts(spark, sf_dir):
    out = T.flag_overlong(turns(spark, sf_dir), F.col("ids"), 150, ["batch_id"])
    return out.select("row_id", F.col("padded_length").cast("bigint").alias("padded_length"), "overlong")


@query("valid_tokens", f"WITH {EXCHANGES_SQL} SELECT row_id, {text_of('range(top_p - np, top_p + nr)')} AS valid FROM e")
def valid_tokens(spark, sf_dir):
    rows = mask_rows(spark, sf_dir)
    rows = rows.withColumn("value", F.sequence(F.lit(0), F.size("attention_mask") - 1))
    return rows.select("row_id", K.shown(T.valid_tokens(rows, "value", "attention_mask")).alias("valid"))


@query("pad_ragged", TURNS + f""", m AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS top, max(n) OVER () AS all_top FROM k)
SELECT row_id, {text_of(f"list_concat(ids, {repeat(-1, 'greatest(top, 120) - n')})")} AS padded, greatest(all_top, 40) AS whole_batch_length FROM m""")
def pad_ragged(spark, sf_dir):
    t = turns(spark, sf_dir)
    by_batch = T.pad_ragged(t, "ids", -1, 120, ["batch_id"]).select("row_id", K.shown(F.col("ids")).alias("padded"))
    whole = T.pad_ragged(t, "ids", -1, 40).select("row_id", F.size("ids").cast("bigint").alias("whole_batch_length"))
    return attach(by_batch, whole, ["row_id"])


@query("pad_to_length", TURNS + f""" SELECT row_id, {text_of(f"list_concat(ids, {repeat(0, '40 - n')})")} AS right_padded,
{text_of(f"list_concat({repeat(0, '40 - n')}, ids)")} AS left_padded FROM k""")
def pad_to_length(spark, sf_dir):
    i = F.col("ids")
    return turns(spark, sf_dir).select("row_id", K.shown(K.pad_to_length(i, 40, 0)).alias("right_padded"),
                                       K.shown(K.pad_to_length(i, 40, 0, left=True)).alias("left_padded"))


@query("tokenize_pad_truncate", TURNS + f""" SELECT row_id, {text_of(f"list_concat({repeat(0, '40 - n')}, ids[greatest(n - 39, 1):n])")} AS cut_left,
{text_of(f"list_concat(ids[1:40], {repeat(0, '40 - n')})")} AS cut_right, {text_of(f"list_concat({repeat(1, 'least(n, 40)')}, {repeat(0, '40 - n')})")} AS mask_right FROM k""")
def tokenize_pad_truncate(spark, sf_dir):
    i, m = F.col("ids"), K.ones(F.col("ids"))
    left, _ = K.pad_and_truncate(i, m, 40, 0, left_pad=True, truncation="left")
    right, mask = K.pad_and_truncate(i, m, 40, 0, left_pad=False, truncation="right")
    return turns(spark, sf_dir).select("row_id", K.shown(left).alias("cut_left"), K.shown(right).alias("cut_right"),
                                       K.shown(mask).alias("mask_right"))


@query("strip_left_pad", TURNS + f" SELECT row_id, {text_of('ids')} AS by_mask, {text_of('ids')} AS by_pad FROM k")
def strip_left_pad(spark, sf_dir):
    i = F.col("ids")
    padded = turns(spark, sf_dir).select("row_id", K.pad_to_length(i, 200, -1, left=True).alias("p"),
                                         K.pad_to_length(K.ones(i), 200, 0, left=True).alias("m"))
    return padded.select("row_id", K.shown(K.strip_by_mask(F.col("p"), F.col("m"))).alias("by_mask"),
                         K.shown(K.strip_by_pad(F.col("p"), -1)).alias("by_pad"))


@query("sft_example", f"""WITH {EXCHANGES_SQL}, k AS (SELECT row_id, list_concat(p, r) AS ids, np, np + nr AS n FROM e)
SELECT row_id, {text_of(f"list_concat(ids[1:256], {repeat(-1, '256 - n')})")} AS input_ids,
{text_of("[CASE WHEN i < least(n, 256) THEN 1 ELSE 0 END for i in range(256)]")} AS attention_mask,
{text_of("[least(i, n - 1) for i in range(256)]")} AS position_ids,
{text_of("[CASE WHEN i < least(np, 256) - 1 OR i >= least(n, 256) - 1 THEN 0 ELSE 1 END for i in range(256)]")} AS loss_mask FROM k""")
def sft_example(spark, sf_dir):
    """One example per exchange of a conversation."""
    parts = K.sft_example(F.col("p"), F.col("r"), 256, -1, "right")
    return exchanges(spark, sf_dir).select("row_id", *[K.shown(v).alias(n) for n, v in parts.items()])


@query("sft_text_batch", TURNS + f""" SELECT row_id, {text_of(f"list_concat(ids[1:40], {repeat(-1, '40 - n')})")} AS input_ids,
{text_of("[CASE WHEN i < n THEN 1 ELSE 0 END for i in range(39)]")} AS loss_mask,
{text_of(f"list_concat(ids[1:40], {repeat(-1, '40 - n')})[2:40]")} AS labels FROM k""")
def sft_text_batch(spark, sf_dir):
    parts = K.sft_text_batch(F.col("ids"), 40, -1)
    return turns(spark, sf_dir).select("row_id", *[K.shown(parts[n]).alias(n) for n in ("input_ids", "loss_mask", "labels")])


@query("rl_example", TURNS + f""" SELECT row_id, {text_of(f"list_concat({repeat(-1, '40 - n')}, ids[greatest(n - 39, 1):n])")} AS input_ids,
{text_of("[CASE WHEN i >= 40 - n THEN 1 ELSE 0 END for i in range(40)]")} AS attention_mask,
{text_of("[greatest(i - greatest(40 - n, 0), 0) for i in range(40)]")} AS position_ids FROM k""")
def rl_example(spark, sf_dir):
    out = T.rl_example(turns(spark, sf_dir), F.col("ids"), 40, -1, truncation="left")
    return out.select("row_id", *[K.shown(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "position_ids")])


@query("rl_batch_left_pad", TURNS + f""", m AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS top FROM k)
SELECT row_id, text AS query, row_id % 7 AS ground_truth, {text_of(f"list_concat({repeat(-1, 'top - n')}, ids)")} AS input_ids,
{text_of(f"list_concat({repeat(0, 'top - n')}, {repeat(1, 'n')})")} AS attention_mask FROM m""")
def rl_batch_left_pad(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("ground_truth", F.col("row_id") % 7).withColumnRenamed("text", "query")
    out = T.left_pad_batch(t, "ids", -1, ["batch_id"])
    return out.select("row_id", "query", "ground_truth", K.shown(F.col("ids")).alias("input_ids"), K.shown(F.col("attention_mask")).alias("attention_mask"))


@query("assemble_rollout", f"""WITH {EXCHANGES_SQL}, z AS (SELECT row_id, p, np, list_concat(r, {repeat(-1, 'greatest(top_r, 90) - nr')}) AS r FROM e),
y AS (SELECT *, coalesce(list_position(r, -2), 0) AS eos FROM z)
SELECT row_id, {text_of(f"list_concat({repeat(-1, '60 - np')}, p[greatest(np - 59, 1):np], r)")} AS input_ids,
{text_of(f"list_concat({repeat(0, '60 - np')}, {repeat(1, 'least(np, 60)')}, [CASE WHEN eos = 0 OR i < eos THEN 1 ELSE 0 END for i in range(len(r))])")} AS attention_mask FROM y""")
def assemble_rollout(spark, sf_dir):
    """Responses of every exchange, padded to the longest of their training batch."""
    t = in_batches(exchanges(spark, sf_dir))
    prompts, mask = K.pad_and_truncate(F.col("p"), K.ones(F.col("p")), 60, -1, left_pad=True, truncation="left")
    out = T.assemble_rollout(t.select("row_id", "batch_id", prompts.alias("p"), mask.alias("m"), "r"), "p", "m", "r", [-2], -1, 90, ["batch_id"])
    return out.select("row_id", K.shown(F.col("input_ids")).alias("input_ids"), K.shown(F.col("attention_mask")).alias("attention_mask"))


PACK = f"""WITH {EXCHANGES_SQL}, cu AS (SELECT batch_id, 0 AS pos, 0 AS cu_seqlen FROM e WHERE pos = 0 UNION ALL
 SELECT batch_id, pos + 1, CAST(sum(np + nr) OVER (PARTITION BY batch_id ORDER BY pos) AS BIGINT) FROM e)"""


@query("pack_sequences", PACK + """ SELECT batch_id, 'cu_seqlens' AS part, pos, cu_seqlen AS value FROM cu UNION ALL
SELECT batch_id, 'index', g, g FROM (SELECT batch_id, pos * (top_p + top_r) + unnest(range(top_p - np, top_p + nr)) AS g FROM e)
UNION ALL SELECT batch_id, 'max_seqlen', 0, max(np + nr) FROM e GROUP BY batch_id""")
def pack_sequences(spark, sf_dir):
    rows = mask_rows(spark, sf_dir)
    indices, cumulative = T.pack_sequences(rows, "pos", "attention_mask", ["batch_id"])
    return (cumulative.select("batch_id", F.lit("cu_seqlens").alias("part"), "pos", F.col("cu_seqlen").alias("value"))
            .unionByName(indices.select("batch_id", F.lit("index").alias("part"), F.col("index").alias("pos"), F.col("index").alias("value")))
            .unionByName(T.longest_packed(rows, "attention_mask", ["batch_id"]).select(
                "batch_id", F.lit("max_seqlen").alias("part"), F.lit(0).cast("bigint").alias("pos"), F.col("max_seqlen").alias("value"))))


@query("pad_packed", PACK + """, s AS (SELECT batch_id, max(cu_seqlen) AS total, max(pos) AS last, (512 - max(cu_seqlen) % 512) % 512 AS pad FROM cu GROUP BY batch_id)
SELECT batch_id, 'cu_seqlens' AS part, pos, cu_seqlen AS value FROM cu UNION ALL SELECT batch_id, 'cu_seqlens', last + 1, total + pad FROM s WHERE pad > 0
UNION ALL SELECT batch_id, 'max_seqlen', 0, greatest(max(np + nr), any_value(pad)) FROM e JOIN s USING (batch_id) GROUP BY batch_id
UNION ALL SELECT batch_id, 'pad_size', 0, pad FROM s""")
def pad_packed(spark, sf_dir):
    rows = mask_rows(spark, sf_dir)
    _, cumulative = T.pack_sequences(rows, "pos", "attention_mask", ["batch_id"])
    cumulative, longest = T.pad_packed(cumulative, T.longest_packed(rows, "attention_mask", ["batch_id"]), 512, ["batch_id"])
    zero = F.lit(0).cast("bigint").alias("pos")
    return (cumulative.select("batch_id", F.lit("cu_seqlens").alias("part"), "pos", F.col("cu_seqlen").alias("value"))
            .unionByName(longest.select("batch_id", F.lit("max_seqlen").alias("part"), zero, F.col("max_seqlen").alias("value")))
            .unionByName(longest.select("batch_id", F.lit("pad_size").alias("part"), zero, F.col("pad_size").alias("value"))))


@query("rescore_chat", f"""WITH c AS (SELECT conv_id, string_agg('[' || role || '] ' || text || ' ;', '' ORDER BY turn) || '[assistant] ' || min_by(text, turn) || ' ;' AS text
 FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, text, {ids('text')} AS ids FROM c), n AS (SELECT *, len(ids) AS n FROM k)
SELECT conv_id, text, {text_of(f"list_concat(ids[1:100], {repeat(-1, '100 - n')})")} AS input_ids,
{text_of("[CASE WHEN i < n THEN 1 ELSE 0 END for i in range(100)]")} AS attention_mask,
{text_of("[least(i, n - 1) for i in range(100)]")} AS position_ids FROM n""")
def rescore_chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chats = records.collect_turns(c, ["conv_id"], "turn", "role", "text")
    said = c.groupBy("conv_id").agg(F.concat(F.min_by("text", "turn"), F.lit("</s>")).alias("response"))
    out = T.rescore_chat(attach(chats, said, ["conv_id"]), "chat", "response", "</s>", 100, -1,
                         header_open="[", header_close="] ", turn_end=" ;")
    return out.select("conv_id", "text", *[K.shown(F.col(x)).alias(x) for x in ("input_ids", "attention_mask", "position_ids")])


@query("preference_pairs", f"""WITH q AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS p, arg_max(text, length(text) * 1000 - turn) FILTER (role = 'assistant') AS c,
 arg_min(text, length(text) * 1000 + turn) FILTER (role = 'assistant') AS r FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, list_append(list_concat({ids('p')}, {ids('c')}), -2) AS c, list_append(list_concat({ids('p')}, {ids('r')}), -2) AS r
 FROM q WHERE p IS NOT NULL AND c IS NOT NULL)
SELECT conv_id, {text_of(f"list_concat(c[1:80], {repeat(0, '80 - len(c)')})")} AS chosen_ids, {text_of(f"list_concat(r[1:80], {repeat(0, '80 - len(r)')})")} AS rejected_ids,
least(len(c), 80) AS chosen_valid, least(len(r), 80) AS rejected_valid FROM t""")
def preference_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    prompts = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    answers = T.best_and_worst(c.where("role = 'assistant'"), ["conv_id"], "text", F.length("text"), F.col("turn"))
    out = T.preference_pairs(attach(prompts, answers, ["conv_id"]), "prompt", "chosen", "rejected", 80, -2)
    return out.select("conv_id", K.shown(F.col("chosen_ids")).alias("chosen_ids"), K.shown(F.col("rejected_ids")).alias("rejected_ids"),
                      K.mask_total(F.col("chosen_mask")).alias("chosen_valid"), K.mask_total(F.col("rejected_mask")).alias("rejected_valid"))


MARKED = "SELECT doc_id, replace(replace(replace(text, 'en', '<<en>>'), 'ou', 'o>>u'), 'th', '<<th') AS text FROM {documents}"
CLEAN = "regexp_replace(text, '<<(.*?)(?:>>|\\z)', '\\1', 'gs')"


@query("strip_markers", f"""SELECT doc_id, md5({CLEAN}) AS cleaned, length({CLEAN}) AS n_chars,
CAST(list_sum(list_append([length(x) for x in regexp_extract_all(text, '(?s)<<(.*?)(?:>>|\\z)', 1)], 0)) AS BIGINT) AS n_inside FROM ({plain(MARKED)})""")
def strip_markers(spark, sf_dir):
    rows = bound(spark, sf_dir, MARKED)
    out = rows.select("doc_id", K.strip_markers(F.col("text")).alias("c"), K.marker_mask(F.col("text")).alias("m"))
    return out.select("doc_id", F.md5("c").alias("cleaned"), F.length("m").cast("bigint").alias("n_chars"),
                      F.length(F.replace("m", F.lit("0"), F.lit(""))).cast("bigint").alias("n_inside"))


@query("content_token_mask", f"""WITH c AS (SELECT doc_id, {CLEAN} AS clean,
 regexp_replace(text, '<<(.*?)(?:>>|\\z)', chr(1) || '\\1' || chr(2), 'gs') AS t FROM ({plain(MARKED)})),
w AS (SELECT doc_id, clean, regexp_extract_all(t, '[^ \\t\\r\\n]+') AS words FROM c),
u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
o AS (SELECT *, sum(length(w) - length(replace(w, chr(1), '')) - length(w) + length(replace(w, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM u)
SELECT doc_id, md5(string_agg(CASE WHEN regexp_full_match(CASE WHEN coalesce(open, 0) > 0 THEN chr(1) || w ELSE w END, '(?s).*\\x01[^\\x02]+.*') THEN '1' ELSE '0' END, '' ORDER BY i)) AS mask,
 count(*) AS n_tokens FROM o WHERE length(replace(replace(w, chr(1), ''), chr(2), '')) > 0 GROUP BY doc_id""")
def content_token_mask(spark, sf_dir):
    bits = F.array_join(F.transform(F.col("t")["inside"], lambda f: F.when(f, "1").otherwise("0")), "")
    return bound(spark, sf_dir, MARKED).select("doc_id", K.content_token_mask(F.col("text")).alias("t")).select(
        "doc_id", F.md5(bits).alias("mask"), F.size(F.col("t")["words"]).cast("bigint").alias("n_tokens"))


@query("md5_key", "SELECT page_id, md5(url) AS path_key FROM pages")
def md5_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("path_key"))


VOCABULARY = r"""WITH pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS place, unnest(p) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[ \t\n\r\f]+|[^ \t\n\r\f]+') AS p FROM documents)),
counts AS (SELECT token, count(*) AS n FROM pieces GROUP BY token),
vocabulary AS (SELECT token, 2 + row_number() OVER (ORDER BY n DESC, token) AS id, n FROM counts)"""


@query("vocabulary", VOCABULARY + " SELECT token, id, n FROM vocabulary UNION ALL VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<eos>', 2, 0)")
def vocabulary(spark, sf_dir):
    return V.build(table(spark, sf_dir, "documents"))


@query("vocabulary_encode", VOCABULARY + """, frequent AS (SELECT * FROM vocabulary WHERE n >= 2)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (id IS NULL) AS n_unknown, md5(string_agg(CAST(coalesce(id, 1) AS VARCHAR), ',' ORDER BY place)) AS ids
FROM pieces LEFT JOIN frequent USING (token) GROUP BY doc_id""")
def vocabulary_encode(spark, sf_dir):
    """Pieces seen once are left out of the vocabulary here."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    encoded = V.encode(docs, V.build(docs, least=2), "doc_id")
    unknown = F.size(F.filter("ids", lambda i: i == V.UNKNOWN)).cast("bigint")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), unknown.alias("n_unknown"), F.md5(F.array_join("ids", ",")).alias("ids"))


@query("vocabulary_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def vocabulary_round_trip(spark, sf_dir):
    """Every document again from its ids."""
    docs = table(spark, sf_dir, "documents")
    known = V.build(docs)
    return V.decode(V.encode(docs, known, "doc_id"), known, "doc_id").select("doc_id", F.md5("text").alias("digest"))
