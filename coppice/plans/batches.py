"""Record shaping, filters, merges, and the position-based batch algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import balance, batch, records
from ..operators.joins import attach
from ..operators.ordered import id_bucket, with_position
from .common import bound, plain, query, table

RAW = """SELECT p_partkey, 'How many ' || p_name || ' does ' || p_brand || ' have?' AS query,
  'Then x = ' || p_size || '.' AS response, CAST(p_partkey % 11 + 15 AS INT) AS num_ops,
  CAST(p_size * 50 - 1200 AS BIGINT) AS final_answer, 'Then x = <<' || p_size || '>>.' AS response_with_mask FROM {part}"""
PROMPT = records.SYSTEM_PROMPT.replace("'", "''")


def raw_problems(spark, sf_dir):
    return bound(spark, sf_dir, RAW)


# ---------------------------------------------------------------- projections
@query("batch_select", "SELECT o_orderkey, o_totalprice FROM orders")
def batch_select(spark, sf_dir):
    return batch.batch_select(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


@query("batch_pop", """SELECT o_orderkey, 'popped' AS side, o_orderstatus || '/' || o_orderpriority AS kept FROM orders
UNION ALL SELECT o_orderkey, 'rest', CAST(o_custkey AS VARCHAR) FROM orders""")
def batch_pop(spark, sf_dir):
    popped, rest = batch.batch_pop(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    assert "o_orderstatus" not in rest.columns
    return (popped.select("o_orderkey", F.lit("popped").alias("side"),
                          F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("kept"))
            .unionByName(rest.select("o_orderkey", F.lit("rest").alias("side"), F.col("o_custkey").cast("string").alias("kept"))))


@query("batch_rename", "SELECT o_orderkey AS row_id, o_totalprice AS reward FROM orders")
def batch_rename(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return batch.batch_rename(df, ["o_orderkey", "o_totalprice"], ["row_id", "reward"])


@query("shape_rl_record", f"""SELECT p_partkey, 'igsm' AS data_source, 'system' AS role0, '{PROMPT}' AS content0, 'user' AS role1,
query AS content1, 'math' AS ability, 'rule' AS style, CAST(final_answer AS VARCHAR) AS ground_truth, num_ops, response AS answer
FROM ({plain(RAW)})""")
def shape_rl_record(spark, sf_dir):
    df = records.shape_rl_record(raw_problems(spark, sf_dir), keep=["p_partkey"])
    return df.select("p_partkey", "data_source", F.col("prompt")[0]["role"].alias("role0"),
                     F.col("prompt")[0]["content"].alias("content0"), F.col("prompt")[1]["role"].alias("role1"),
                     F.col("prompt")[1]["content"].alias("content1"), "ability", "reward_model.style",
                     "reward_model.ground_truth", "extra_info.num_ops", "extra_info.answer")


@query("shape_sft_record", f"""SELECT p_partkey, 'system,user,assistant' AS roles, query || '|' || response AS turns, num_ops, final_answer,
response_with_mask AS answer_with_mask, 0 AS marked_without_column FROM ({plain(RAW)})""")
def shape_sft_record(spark, sf_dir):
    raw = raw_problems(spark, sf_dir)
    df = records.shape_sft_record(raw, keep=["p_partkey"])
    bare = records.shape_sft_record(raw.drop("response_with_mask"), keep=["p_partkey"]).select(
        "p_partkey", F.col("extra_info.answer_with_mask").isNotNull().cast("int").alias("marked_without_column"))
    m = F.col("message")
    shaped = df.select("p_partkey", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
                       F.concat_ws("|", m[1]["content"], m[2]["content"]).alias("turns"), "extra_info.num_ops",
                       "extra_info.final_answer", "extra_info.answer_with_mask")
    return attach(shaped, bare, ["p_partkey"])


HEADS = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>'"


def chats(spark, sf_dir):
    return records.collect_turns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


@query("render_chat", f"""SELECT conv_id, string_agg({HEADS}, '' ORDER BY turn) AS text, string_agg({HEADS}, '' ORDER BY turn)
|| '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || '<think>' AS query FROM conversations GROUP BY conv_id""")
def render_chat(spark, sf_dir):
    c = F.col("chat")
    return chats(spark, sf_dir).select("conv_id", records.render_chat(c).alias("text"),
                                       records.render_chat(c, generation_prompt=True, suffix=records.THINK_PREFIX).alias("query"))


@query("raw_prompt_keep", f"""SELECT conv_id, string_agg({HEADS}, '' ORDER BY turn) AS text,
string_agg(role || ':' || text, '|' ORDER BY turn) AS raw_prompt FROM conversations GROUP BY conv_id""")
def raw_prompt_keep(spark, sf_dir):
    kept = chats(spark, sf_dir).select("conv_id", records.render_chat(F.col("chat")).alias("text"), "chat")
    return kept.select("conv_id", "text", F.array_join(F.transform(
        "chat", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("raw_prompt"))


@query("extract_nested_key", f"SELECT p_partkey, query AS prompt, response AS answer FROM ({plain(RAW)})")
def extract_nested_key(spark, sf_dir):
    raw = raw_problems(spark, sf_dir).select("p_partkey", F.array(F.struct(
        F.struct(F.col("query").alias("text")).alias("content"))).alias("prompt"),
        F.array(F.array(F.struct(F.col("response").alias("content")))).alias("response"))
    return raw.select("p_partkey", records.extract_nested_key(raw, "prompt", ["content", "text"]).alias("prompt"),
                      records.extract_nested_key(raw, "response", ["content"]).alias("answer"))


@query("default_index", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_partkey ELSE 0 END AS idx, CAST(0 AS BIGINT) AS absent FROM part""")
def default_index(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.struct(
        F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("index")).alias("extra_info"))
    return df.select("p_partkey", records.default_index(df).alias("idx"), records.default_index(df.drop("extra_info")).alias("absent"))


@query("rows_to_columns", """SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id""")
def rows_to_columns(spark, sf_dir):
    df = batch.rows_to_columns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return df.select("conv_id", F.array_join("role", ",").alias("roles"), F.array_join("text", "|").alias("texts"))


@query("columns_to_rows", """SELECT doc_id, pos, word, length(word) AS n FROM (SELECT doc_id, unnest(words) AS word,
 generate_subscripts(words, 1) - 1 AS pos FROM (SELECT doc_id, [w for w in regexp_split_to_array(text, '[ \\t\\r\\n]+') if w <> ''] AS words FROM documents))""")
def columns_to_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", K.word_tokens(F.col("text")).alias("word"))
    docs = docs.withColumn("n", F.transform("word", lambda w: F.length(w).cast("bigint")))
    return batch.columns_to_rows(docs, ["doc_id"], ["word", "n"])


@query("batch_from_columns", "SELECT vec_id, label, len(embedding) AS width, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def batch_from_columns(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("int"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return df.select("vec_id", "label", F.size("x").cast("bigint").alias("width"), F.col("x")[0].alias("first"))


@query("batch_check", "SELECT doc_id FROM documents WHERE doc_id % 13 = 5 AND doc_id % 3 <> 0")
def batch_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.array_repeat(F.lit(1), F.lit(4)).alias("ids"),
        F.array_repeat(F.lit(1), F.when((F.col("doc_id") % 13 == 5) & (F.col("doc_id") % 3 != 0), 3).otherwise(4)).alias("mask"))
    return batch.ragged_rows(docs, ["ids", "mask"]).select("doc_id")


@query("batch_bytes", """SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) AS numeric_bytes,
(SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents) AS object_bytes FROM embeddings""")
def batch_bytes(spark, sf_dir):
    numeric = batch.batch_bytes(table(spark, sf_dir, "embeddings"), {"embedding": 4}, []).select("numeric_bytes")
    objects = batch.batch_bytes(table(spark, sf_dir, "documents"), {}, ["text"]).select("object_bytes")
    return numeric.select(F.col("numeric_bytes").cast("bigint").alias("numeric_bytes"),
                          objects.select(F.col("object_bytes").cast("bigint")).scalar().alias("object_bytes"))


@query("flatten_struct", f"""SELECT p_partkey, 'rule' AS "reward_model/style", CAST(final_answer AS VARCHAR) AS "reward_model/ground_truth",
num_ops AS "extra_info/num_ops", response AS "extra_info/answer" FROM ({plain(RAW)})""")
def flatten_struct(spark, sf_dir):
    df = records.shape_rl_record(raw_problems(spark, sf_dir), keep=["p_partkey"])
    return records.flatten_struct(df.select("p_partkey", "reward_model", "extra_info"))


@query("params_to_json", """SELECT p_partkey, '{"trainer":{"size":' || p_size || ',"name":"' || p_name || '"},"steps":{"list_len":2,"0":' || p_size ||
',"1":' || (p_size + 1) || '}}' AS as_dicts, '{"trainer":{"size":' || p_size || ',"name":"' || p_name || '"},"steps":[' || p_size || ',' || (p_size + 1) || ']}'
AS as_lists FROM part""")
def params_to_json(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name")).alias("trainer"),
                                             F.array(F.col("p_size"), F.col("p_size") + 1).alias("steps"))
    params = df.select("trainer", "steps")
    return df.select("p_partkey", records.params_to_json(params, lists_as_dicts=True).alias("as_dicts"),
                     records.params_to_json(params).alias("as_lists"))


@query("dataset_name", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN t || '_' || n || a || '_CoT_op_' || o || '_detailed_reflect_0.3_analysis_' || p_size % 5
 ELSE t || '_' || n || '_no_CoT_op_' || o END AS name FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'SFT' ELSE 'RL_val' END AS t,
 CASE WHEN p_size > 40 THEN p_size // 10 || 'K' WHEN p_size % 3 = 0 THEN '5K' ELSE '500' END AS n,
 CASE WHEN p_size % 4 = 0 THEN '_4Qaug' WHEN p_size % 4 = 2 THEN '_4Aaug' ELSE '' END AS a,
 CASE WHEN p_size > 30 THEN '20' ELSE '15-20' END AS o FROM part)""")
def dataset_name(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "SFT").otherwise("RL_val")
    ops = records.operations_label(size > 30, F.lit(15), F.lit(20))
    name = records.dataset_name(kind, F.when(size > 40, size * 100).otherwise(-1), F.when(size % 4 == 0, 4).otherwise(-1),
                                F.when(size % 4 == 2, 4).otherwise(-1), size % 2 == 0, ops, F.lit(True), F.lit("0.3"), size % 5)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


# ---------------------------------------------------------------- filters
@query("filter_answer_bound", f"SELECT p_partkey, final_answer FROM ({plain(RAW)}) WHERE abs(final_answer) < 1000")
def filter_answer_bound(spark, sf_dir):
    return records.filter_answer_bound(raw_problems(spark, sf_dir), 1000).select("p_partkey", "final_answer")


@query("downsample_zero_answers", f"""SELECT p_partkey FROM ({plain(RAW)}) WHERE final_answer <> 0 OR
('0x' || substr(md5('7|' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.6""")
def downsample_zero_answers(spark, sf_dir):
    kept = records.downsample_zero_answers(raw_problems(spark, sf_dir), "p_partkey", min_operations=21, seed=7)
    return kept.select("p_partkey")


@query("sample_per_source", """SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
FROM documents) WHERE r <= 2""")
def sample_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return batch.sample_per_source(docs, "source", "doc_id", 2).select("source", "doc_id", "lang")


@query("prefer_model_score", """SELECT doc_id, CAST(coalesce(quality, n_chars % 2) AS BIGINT) AS score FROM documents LEFT JOIN labels USING (doc_id)""")
def prefer_model_score(spark, sf_dir):
    from ..functions.rewards import prefer_model_score as prefer
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("rule"))
    model = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("model"))
    return attach(docs, model, ["doc_id"], "left").select("doc_id", prefer(F.col("model"), F.col("rule")).cast("bigint").alias("score"))


# ---------------------------------------------------------------- merges
@query("batch_union", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def batch_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return batch.batch_union(orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                             orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("batch_union_conflicts", """SELECT o_orderkey, 'o_custkey' AS "column" FROM orders WHERE o_custkey % 50 = 3
UNION ALL SELECT o_orderkey, 'o_orderstatus' FROM orders WHERE o_orderstatus = 'F'""")
def batch_union_conflicts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    other = orders.select("o_orderkey", F.when(F.col("o_custkey") % 50 != 3, F.col("o_custkey")).alias("o_custkey"),
                          F.when(F.col("o_orderstatus") == "F", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return batch.batch_conflicts(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), other, "o_orderkey")


@query("fanout_rollouts", """SELECT c_custkey AS uid, o_orderkey % 10 AS sample, c_mktsegment, o_orderkey FROM customer
JOIN orders ON c_custkey = o_orderkey // 10""")
def fanout_rollouts(spark, sf_dir):
    prompts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), "c_mktsegment")
    responses = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10).alias("uid"),
                                                      (F.col("o_orderkey") % 10).cast("int").alias("sample"), "o_orderkey")
    return batch.fanout_rollouts(prompts, responses, "uid", 10).select("uid", F.col("sample").cast("bigint").alias("sample"), "c_mktsegment", "o_orderkey")


@query("batch_concat", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def batch_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"))
    return batch.batch_concat(c, s)


@query("key_intersection", "SELECT DISTINCT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return c.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


# ---------------------------------------------------------------- positions
ORD = "WITH b AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM b)"


def ordered_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return with_position(df, [F.col("o_orderkey")], id_bucket(F.col("o_orderkey")), total=batch.TOTAL)


def shuffled_sql(seed, key="o_orderkey", source="orders"):
    return f"SELECT {key}, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) - 1 AS pos FROM {source}"


@query("batch_reorder", "SELECT o_orderkey, (o_orderkey + 7) % (SELECT count(*) FROM orders) AS pos FROM orders")
def batch_reorder(spark, sf_dir):
    rows = ordered_orders(spark, sf_dir).select("o_orderkey", "pos")
    shifted = rows.select(F.pmod(F.col("pos") + 7, batch.batch_len(rows)).alias("new_pos"), F.col("pos").alias("old_pos"))
    return batch.batch_reorder(rows, shifted)


@query("reverse_index", f"SELECT pos AS old_pos, o_orderkey AS new_pos FROM ({shuffled_sql('3|0')})")
def reverse_index(spark, sf_dir):
    moved = batch.shuffle_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=3)
    return batch.reverse_index(moved.select(F.col("pos").alias("new_pos"), F.col("o_orderkey").alias("old_pos")))


@query("shuffle_rows", f"""SELECT 'seeded' AS mode, o_orderkey, pos FROM ({shuffled_sql('42|0')}) UNION ALL
SELECT 'sequential', o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 FROM orders""")
def shuffle_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    seeded = batch.shuffle_rows(rows, "o_orderkey", seed=42).select(F.lit("seeded").alias("mode"), "o_orderkey", "pos")
    plain_order = batch.shuffle_rows(rows, "o_orderkey").select(F.lit("sequential").alias("mode"), "o_orderkey", "pos")
    return seeded.unionByName(plain_order)


@query("make_batches", f"""SELECT o_orderkey, pos // 128 AS batch_id, 'train' AS split FROM ({shuffled_sql('42|0')})
WHERE pos // 128 < (SELECT count(*) FROM orders) // 128 UNION ALL SELECT o_orderkey, 0, 'val' FROM orders""")
def make_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    train = batch.make_batches(batch.shuffle_rows(rows, "o_orderkey", seed=42), 128)
    whole = batch.make_batches(rows, None)
    return (train.select("o_orderkey", "batch_id", F.lit("train").alias("split"))
            .unionByName(whole.select("o_orderkey", "batch_id", F.lit("val").alias("split"))))


@query("make_batches_total_steps", "SELECT count(*) // 128 * 3 AS total_steps FROM orders")
def make_batches_total_steps(spark, sf_dir):
    return batch.total_steps(table(spark, sf_dir, "orders"), 128, 3)


@query("resume_batches", ORD + " SELECT o_orderkey, pos // 128 AS batch_id FROM b, n WHERE pos // 128 < n // 128 AND pos // 128 > 20")
def resume_batches(spark, sf_dir):
    return batch.resume_batches(batch.make_batches(ordered_orders(spark, sf_dir), 128), 20).select("o_orderkey", "batch_id")


@query("shard_rows", f"""SELECT o_orderkey, pos % 7 AS rank FROM ({shuffled_sql('5|1')}) WHERE pos < (SELECT count(*) FROM orders) // 7 * 7""")
def shard_rows(spark, sf_dir):
    rows = batch.shuffle_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=5, epoch=1)
    return batch.shard_rows(rows, 7).select("o_orderkey", "rank")


@query("mini_batch_iter", """SELECT o_orderkey, epoch, epoch * (n // 50) + pos // 50 AS mini_batch FROM (SELECT o_orderkey, epoch, count(*) OVER (PARTITION BY epoch) AS n,
row_number() OVER (PARTITION BY epoch ORDER BY md5('9|' || epoch || '|' || o_orderkey), o_orderkey) - 1 AS pos FROM orders, range(2) e(epoch))""")
def mini_batch_iter(spark, sf_dir):
    out = batch.mini_batches(ordered_orders(spark, sf_dir), "o_orderkey", 50, 2, seed=9)
    return out.select("o_orderkey", F.col("epoch").cast("bigint").alias("epoch"), "mini_batch")


@query("batch_slice", ORD + """ SELECT 'head' AS part, o_orderkey FROM b WHERE pos < 100 UNION ALL SELECT 'middle', o_orderkey FROM b WHERE pos >= 40 AND pos < 90
UNION ALL SELECT 'no_tail', o_orderkey FROM b, n WHERE pos < n - 25 UNION ALL SELECT 'item', o_orderkey FROM b WHERE pos = 17""")
def batch_slice(spark, sf_dir):
    rows = ordered_orders(spark, sf_dir)
    cuts = {"head": (None, 100), "middle": (40, 90), "no_tail": (None, -25), "item": (17, 18)}
    return batch.batch_concat(*[batch.batch_slice(rows, *c).select(F.lit(n).alias("part"), "o_orderkey") for n, c in cuts.items()])


@query("batch_len", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_empty FROM orders")
def batch_len(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", batch.batch_len(rows.where("o_orderkey < 0")).alias("n_empty"))


@query("batch_chunk", ORD + " SELECT o_orderkey, pos // (n // 6) AS chunk FROM b, n")
def batch_chunk(spark, sf_dir):
    return batch.batch_chunk(ordered_orders(spark, sf_dir), 6).select("o_orderkey", "chunk")


@query("batch_repeat", ORD + """ SELECT 'interleave' AS mode, o_orderkey, pos * 3 + r AS pos FROM b, range(3) x(r)
UNION ALL SELECT 'tile', o_orderkey, r * n + pos FROM b, n, range(3) x(r)""")
def batch_repeat(spark, sf_dir):
    rows = ordered_orders(spark, sf_dir)
    return batch.batch_concat(*[batch.batch_repeat(rows, 3, mode == "interleave").select(F.lit(mode).alias("mode"), "o_orderkey", "pos")
                                for mode in ("interleave", "tile")])


PAD = ORD + """, p AS (SELECT n, (64 - n % 64) % 64 AS pad FROM n)
, padded AS (SELECT o_orderkey, pos, 0 AS is_pad FROM b UNION ALL SELECT o_orderkey, n + i, 1 FROM p, range(64) x(i) JOIN b ON true
  WHERE i < pad AND b.pos = i % n)"""


@query("pad_to_divisor", PAD + " SELECT o_orderkey, pos, is_pad FROM padded")
def pad_to_divisor(spark, sf_dir):
    return batch.pad_to_divisor(ordered_orders(spark, sf_dir), 64).select("o_orderkey", "pos", "is_pad")


@query("unpad", ORD + " SELECT o_orderkey, pos FROM b")
def unpad(spark, sf_dir):
    return batch.unpad(batch.pad_to_divisor(ordered_orders(spark, sf_dir), 64)).select("o_orderkey", "pos")


@query("fold_batch", ORD + """ SELECT pos // (n // 10) AS fold, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY pos) AS rows FROM b, n GROUP BY 1""")
def fold_batch(spark, sf_dir):
    folded = batch.fold_batch(ordered_orders(spark, sf_dir), 10, ["o_orderkey"])
    return folded.select("fold", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("rows"))


@query("unfold_batch", ORD + " SELECT o_orderkey, pos FROM b")
def unfold_batch(spark, sf_dir):
    return batch.unfold_batch(batch.fold_batch(ordered_orders(spark, sf_dir), 10, ["o_orderkey"], largest=batch.FOLD_CHUNK), ["o_orderkey"]).select("o_orderkey", "pos")


@query("sample_generations", """WITH s AS (SELECT p_name || p_partkey AS i, p_brand AS o, p_retailprice AS s,
 row_number() OVER (ORDER BY md5('42|' || p_name || p_partkey), p_name || p_partkey) AS r FROM part)
SELECT 7 AS step, max(i) FILTER (r = 1) AS input_1, max(o) FILTER (r = 1) AS output_1, max(s) FILTER (r = 1) AS score_1,
 max(i) FILTER (r = 2) AS input_2, max(o) FILTER (r = 2) AS output_2, max(s) FILTER (r = 2) AS score_2,
 max(i) FILTER (r = 3) AS input_3, max(o) FILTER (r = 3) AS output_3, max(s) FILTER (r = 3) AS score_3 FROM s""")
def sample_generations(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("input"), F.col("p_brand").alias("output"),
                                               F.col("p_retailprice").alias("score"))
    return batch.sample_generations(rows, 3, step=7)


@query("batch_size_check", """SELECT n_regionkey AS nodes, n_nationkey, CASE WHEN (n_nationkey + 1) * 4 % ((n_regionkey + 1) * 2) = 0 THEN 1 ELSE 0 END
AS divides FROM nation""")
def batch_size_check(spark, sf_dir):
    config = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("nodes"), "n_nationkey")
    return batch.batch_size_check(config, (F.col("n_nationkey") + 1) * 4, (F.col("nodes") + 1) * 2)


# ---------------------------------------------------------------- balancing
def batched_docs(spark, sf_dir, size=200):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(K.word_tokens(F.col("text"))) + 1).cast("bigint").alias("length"))
    placed = with_position(docs, [F.col("doc_id")], id_bucket(F.col("doc_id")), total=batch.TOTAL)
    return batch.make_batches(placed, size, drop_last=False)


TOKENS = "len([w for w in regexp_split_to_array(text, '[ \\t\\r\\n]+') if w <> '']) + 1"
DOC_LENGTHS = f"SELECT doc_id AS pos, doc_id // 200 AS batch_id, {TOKENS} AS length FROM documents"


def part_facts(batched, assigned):
    """Per batch: rows placed once, parts, rows of the smallest and the largest part, and all tokens."""
    placed = batched.select("batch_id", "pos", "length").join(assigned.dropDuplicates(["batch_id", "pos"]), ["batch_id", "pos"])
    parts = placed.groupBy("batch_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"))
    return parts.groupBy("batch_id").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_parts"), F.min("n").alias("min_rows"),
                                         F.max("n").alias("max_rows"), F.sum("t").alias("tokens"))


@query("balance_partitions", f"""SELECT batch_id, count(*) AS n_rows, 8::BIGINT AS n_parts, count(*) // 8 AS min_rows, count(*) // 8 AS max_rows,
CAST(sum(length) AS BIGINT) AS tokens FROM ({DOC_LENGTHS}) GROUP BY batch_id""")
def balance_partitions(spark, sf_dir):
    batched = batched_docs(spark, sf_dir)
    return part_facts(batched, balance.balance_partitions(batched, 8, equal_size=True))


@query("balance_greedy", f"""WITH RECURSIVE d AS ({DOC_LENGTHS}),
g AS (SELECT batch_id, min(pos) - 1 AS pos, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS sums, CAST(-1 AS INT) AS part FROM d GROUP BY batch_id
  UNION ALL SELECT g.batch_id, d.pos, [CASE WHEN i = list_position(sums, list_min(sums)) THEN sums[i] + length ELSE sums[i] END for i in range(1, 9)],
   CAST(list_position(sums, list_min(sums)) - 1 AS INT) FROM g JOIN d ON d.batch_id = g.batch_id AND d.pos = g.pos + 1)
SELECT batch_id, pos, part FROM g WHERE part >= 0""")
def balance_greedy(spark, sf_dir):
    return balance.balance_greedy(batched_docs(spark, sf_dir), 8)


@query("micro_batches_by_tokens", f"""SELECT batch_id, count(*) AS n_rows, CAST(ceil(sum(length) / 32768) AS BIGINT) AS n_parts,
CAST(sum(length) AS BIGINT) AS tokens FROM ({DOC_LENGTHS}) GROUP BY batch_id""")
def micro_batches_by_tokens(spark, sf_dir):
    batched = batched_docs(spark, sf_dir)
    return part_facts(batched, balance.micro_batches(batched, max_tokens=32768, padded_length=32768)).drop("min_rows", "max_rows")


ASSIGNED = """SELECT doc_id FROM documents WHERE doc_id % 97 <> 5 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 89 = 3"""


@query("partition_cover_check", f"""SELECT doc_id, CAST(1 AS BIGINT) AS expected, coalesce(n, 0) AS assigned FROM documents LEFT JOIN
(SELECT doc_id, count(*) AS n FROM ({ASSIGNED}) GROUP BY doc_id) USING (doc_id) WHERE coalesce(n, 0) <> 1""")
def partition_cover_check(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    assigned = ids.where("doc_id % 97 <> 5").unionByName(ids.where("doc_id % 89 = 3"))
    return balance.cover_violations(ids, assigned, "doc_id")


@query("coverage_except", f"""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL ({ASSIGNED}))) AS missing,
(SELECT count(*) FROM (({ASSIGNED}) EXCEPT ALL SELECT doc_id FROM documents)) AS extra""")
def coverage_except(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    assigned = ids.where("doc_id % 97 <> 5").unionByName(ids.where("doc_id % 89 = 3"))
    count = F.count(F.lit(1))
    missing = ids.exceptAll(assigned).agg(count.alias("missing"))
    return missing.select("missing", assigned.exceptAll(ids).agg(count.alias("extra")).scalar().alias("extra"))
