"""Rewards by rule and their routing, advantages by estimator, and the composed loss, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import advantages as A
from ..functions import rewards as W
from ..functions import samples as P
from ..functions import tokens as T
from ..operators.generation import group_rewards, sampled_rows
from ..operators.scores import routed_rewards
from .base import TOKENS, Registry, r6, table, tokens
from .token_plans import digest, digested

R = Registry()

#: Lines that one task may well sort.
LINES_A_TASK = 1_000_000


def k():
    return F.col("o_orderkey")


@R.add("SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 ELSE (o_orderpriority='1-URGENT')::INT END::DOUBLE AS reward FROM orders")
def tx11_multiple_choice(spark, sf):
    """A right letter, a wrong one, the text of the right choice, a label given as text, nothing, and a letter that depends on the row."""
    n = k() % 6
    response = (
        F.when(n == 0, F.lit("<think>Answer: A</think> The answer is B."))
        .when(n == 1, F.lit("So C is correct"))
        .when(n == 2, F.concat(F.lit("it must be the "), F.col("o_orderpriority"), F.lit(" one")))
        .when(n == 3, F.lit("Option: a"))
        .when(n == 4, F.lit("no idea"))
        .otherwise(F.when(F.col("o_orderpriority") == "1-URGENT", "I choose (B)").otherwise("I choose (D)"))
    )
    choices = F.array(F.lit("red fox"), F.col("o_orderpriority"), F.lit("blue"), F.lit("green"))
    label = F.when(n == 3, F.lit("Red Fox!")).otherwise(F.lit("B"))
    return table(spark, sf, "orders").select("o_orderkey", W.multiple_choice_reward(response, label, choices).alias("reward"))


@R.add("SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 1.0 WHEN 1 THEN round(2.0*1/3,6) WHEN 2 THEN 1.0 ELSE o_totalprice END::DOUBLE AS reward FROM orders")
def tx33_routed_reward(spark, sf):
    n = k() % 4
    kind = F.when(n == 0, "math").when(n == 1, "f1").when(n == 2, "boxed_f1").otherwise("workbench")
    response = F.when(n == 0, F.format_string("so \\boxed{%d}", k())).when(n == 1, F.lit("the cat")).otherwise(F.lit("see \\boxed{red cat}"))
    label = F.when(n == 0, k().cast("string")).otherwise(F.when(n == 1, "cat sat").otherwise("a red cat"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", kind.alias("kind"), response.alias("response"), label.alias("label"))
    return routed_rewards(o, "kind", "response", "label", F.when(F.col("o_orderkey") % 4 == 3, F.col("o_totalprice"))).select("o_orderkey", F.round("reward", 6).alias("reward"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 2 ELSE 3 END AS n, CASE WHEN o_orderkey%3=0 THEN 0 ELSE 1 END AS keys, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderpriority END AS last FROM orders")
def tx38_instruction_kwargs(spark, sf):
    raw = F.when(k() % 3 == 0, F.lit(None)).otherwise(F.array(F.create_map(F.lit("n"), F.lit("1")), F.create_map(F.lit("w"), F.col("o_orderpriority"), F.lit("x"), F.lit(None).cast("string"))))
    out = W.coerced_kwargs(raw.cast("array<map<string,string>>"), F.when(k() % 3 == 0, 2).otherwise(3))
    return table(spark, sf, "orders").select("o_orderkey", out.alias("m")).select("o_orderkey", F.size("m").alias("n"), F.size(F.element_at("m", -1)).alias("keys"), F.element_at("m", -1)["w"].alias("last"))


@R.add("SELECT event_id, CASE WHEN event_type='click' THEN 'accepted' WHEN event_id%4=0 THEN 'timeout' WHEN event_id%4=1 THEN 'sandbox_error' WHEN event_id%4=2 THEN 'wrong_answer' ELSE 'execution_error' END AS outcome FROM events")
def tx41_sandbox_outcome(spark, sf):
    n = F.col("event_id") % 4
    status = F.array(F.when(n == 1, "SandboxError").otherwise("Finished"))
    run, out = F.array(F.when(n == 0, "TimeLimitExceeded")), F.array(F.lit(None).cast("string"), F.when(n == 2, "Wrong answer at 1").otherwise("x"))
    return table(spark, sf, "events").select("event_id", W.sandbox_outcome(F.col("event_type") == "click", status, run, out).alias("outcome"))


@R.add()
def tx42_stable_seed(spark, sf):
    return table(spark, sf, "part").select("p_partkey", W.stable_seed(F.col("p_name"), 3).alias("seed"))


@R.add()
def tx30_compression(spark, sf):
    c = W.compression(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", c.alias("c")).select("doc_id", r6(F.col("c.ratio"), "ratio"), r6(F.col("c.savings"), "savings"))


@R.add()
def pf20_repetitive(spark, sf):
    """Whole texts, as they are and three times over."""
    three = F.repeat("text", F.lit(3))
    return table(spark, sf, "documents").select("doc_id", W.repetitive(F.col("text")).alias("once"), W.repetitive(three).alias("thrice"))


@R.add("SELECT doc_id, CASE WHEN doc_id%2=0 THEN doc_id END AS value FROM documents")
def tx27_decoded_json(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("doc_id"))).otherwise(F.base64(F.col("text").cast("binary")))
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(W.decoded_json(text), "$.doc_id").cast("bigint").alias("value"))


PROMPT = f"e'{W.CODE_TASK}### Question:\n'||text||e'\n\n'||CASE WHEN doc_id%2=0 THEN e'{W.CODE_STARTED}'||source||e'\n```' ELSE e'{W.CODE_FREE}' END||e'{W.CODE_END}'"


@R.add(f"SELECT doc_id, md5({PROMPT}) AS prompt FROM documents")
def tx28_code_prompt(spark, sf):
    starter = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.md5(W.code_prompt(F.col("text"), starter)).alias("prompt"))


@R.add(f"SELECT doc_id, md5({PROMPT}) AS prompt, doc_id::VARCHAR AS question_id, 'livecodebench' AS rm_type, sha256(lower(trim(regexp_replace(text,'\\s+',' ','g')))) AS hash FROM documents")
def tx29_code_benchmark_row(spark, sf):
    starter = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    row = W.code_benchmark_row(F.col("doc_id"), F.col("text"), starter, F.lit("hard")).alias("r")
    return table(spark, sf, "documents").select("doc_id", row).select("doc_id", F.md5("r.prompt").alias("prompt"), "r.metadata.question_id", "r.metadata.rm_type", F.col("r.metadata.question_sha256").alias("hash"))


# advantages

N = "n AS (SELECT vec_id AS v2, count(*) AS n FROM tok GROUP BY 1), t AS (SELECT tok.*, n FROM tok JOIN n ON vec_id=v2)"


@R.add(f"WITH {TOKENS} {digested('reward')}")
def ta9_grpo_advantages(spark, sf):
    kl = F.zip_with("logp", "base", lambda a, b: a - b)
    return digest(tokens(spark, sf), A.advantages("grpo", F.col("reward"), kl, F.col("mask"))[0])


@R.add(
    f"""WITH {TOKENS}, {N}, d AS (SELECT vec_id, i, -0.1*(logp-base) + CASE WHEN i=n-1 THEN reward ELSE 0 END + 0.9*coalesce(lead(adv) OVER (PARTITION BY vec_id ORDER BY i),0) - adv AS delta, adv FROM t),
w AS (SELECT a.vec_id, a.i, sum(b.delta*pow(0.9*0.95,b.i-a.i)) AS v0 FROM d a JOIN d b ON a.vec_id=b.vec_id AND b.i>=a.i GROUP BY ALL) """
    + digested("v0", source="w")
)
def ta9_ppo_advantages(spark, sf):
    kl = F.zip_with("logp", "base", lambda a, b: a - b)
    return digest(tokens(spark, sf), A.advantages("ppo", F.col("reward"), kl, F.col("mask"), F.col("adv"), beta=0.1, gamma=0.9, lam=0.95)[0])


@R.add(f"WITH {TOKENS} {digested('reward-0.1*(logp-base)')}")
def ta9_baseline_advantages(spark, sf):
    kl = F.zip_with("logp", "base", lambda a, b: a - b)
    return digest(tokens(spark, sf), A.advantages("reinforce_plus_plus_baseline", F.col("reward"), kl, F.col("mask"), beta=0.1)[0])


TERMS = f"""WITH {TOKENS}, k AS (SELECT *, exp(logp-old) AS r, greatest(least(exp(logp-old),1.28),0.8) AS c, greatest(least(exp(old-base),1.02),0.5) AS w FROM tok),
s AS (SELECT vec_id, greatest(sum(mask),1.0) AS m, sum(greatest(-r*adv,-c*adv)*w*mask) AS pg, sum(CASE WHEN -c*adv > -r*adv THEN mask ELSE 0 END) AS clip, sum((old-logp)*mask) AS kl, sum(abs(x)*mask) AS ent, sum((exp(-(logp-base))-1+(logp-base))*mask) AS ref, sum(abs(old-base)*mask) AS diff, sum(r*mask) AS ois FROM k GROUP BY 1)
SELECT round(sum(pg/m - 0.01*ent/m + 0.05*ref/m),6) AS loss, round(sum(pg/m),6) AS pg_loss, round(sum(clip/m),6) AS pg_clipfrac, round(sum(kl/m),6) AS ppo_kl, round(sum(ent/m),6) AS entropy_loss, round(sum(ref/m),6) AS kl_loss, round(sum(diff/m),6) AS train_rollout_logprob_abs_diff, round(sum(ois/m),6) AS ois FROM s"""


@R.add(TERMS)
def ta24_policy_loss_terms(spark, sf):
    t = A.policy_terms(
        F.col("logp"), F.col("old"), F.col("adv"), F.col("mask"), F.transform("x", lambda x: F.abs(x)), F.col("base"), F.col("base"),
        eps_low=0.2, eps_high=0.28, entropy_weight=0.01, kl_weight=0.05, kl_kind="k3", clamp_is=(0.5, 1.02),
    )
    names = ("loss", "pg_loss", "pg_clipfrac", "ppo_kl", "entropy_loss", "kl_loss", "train_rollout_logprob_abs_diff", "ois")
    return tokens(spark, sf).select(*[t[n].alias(n) for n in names]).agg(*[r6(F.sum(n), n) for n in names])


@R.add(f"WITH {TOKENS} {digested('CASE WHEN vec_id%2=0 THEN 0 ELSE -0.5*(logp-base) END')}")
def ta27_hybrid_advantages(spark, sf):
    mode = F.when(F.col("vec_id") % 2 == 0, "sft").otherwise("opd")
    zero = F.transform("logp", lambda x: F.lit(0.0))
    return digest(tokens(spark, sf), T.distilled(zero, F.col("logp"), A.neutral_teacher(mode, F.col("logp"), F.col("base")), 0.5))


@R.add(f"WITH {TOKENS}, {N} SELECT vec_id, round(sum(CASE WHEN i>=n-5 THEN logp ELSE 0 END),6) AS total, 5 AS size FROM t GROUP BY 1")
def td5_teacher_values(spark, sf):
    tail = P.teacher_tail(F.col("logp"), F.lit(5))
    return tokens(spark, sf).select("vec_id", r6(T.total(tail), "total"), F.size(tail).alias("size"))


@R.add("WITH r AS (SELECT l_orderkey*8+l_linenumber AS pos, l_orderkey, l_discount*2.5 AS w FROM lineitem) SELECT pos, round(w,6) AS raw, round((w-avg(w) OVER g)/(stddev_samp(w) OVER g+1e-6),6) AS normalised FROM r WINDOW g AS (PARTITION BY l_orderkey)")
def td6_combined_rewards(spark, sf):
    from pyspark.sql.window import Window

    from ..operators.groups import normalised

    raw = A.combined_reward(F.col("l_discount"), 2.5)
    df = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "l_orderkey", raw.alias("w"))
    return df.select("pos", r6(F.col("w"), "raw"), r6(normalised(F.col("w"), Window.partitionBy("l_orderkey")), "normalised"))


@R.add(f"WITH {TOKENS}, {N} SELECT vec_id, CASE WHEN vec_id%2=0 THEN 'sft' ELSE 'opd' END AS mode, round(sum(CASE WHEN vec_id%2=1 AND i>=n-5 THEN logp ELSE 0 END),6) AS total FROM t GROUP BY 1")
def td7_marked_rows(spark, sf):
    mode = F.when(F.col("vec_id") % 2 == 0, "sft").otherwise("opd")
    return tokens(spark, sf).select("vec_id", mode.alias("mode"), r6(T.total(A.marked_teacher(mode, F.col("logp"), F.lit(5))), "total"))


@R.add(f"WITH {TOKENS} SELECT vec_id, (2*count(*))::INT AS tokens, (count(*) + CASE WHEN vec_id%2=1 THEN count(*) ELSE 0 END)::INT AS trained, round(sum(logp) + CASE WHEN vec_id%2=1 THEN sum(base) ELSE 0 END,6) AS total FROM tok GROUP BY 1")
def ta28_appended_response(spark, sf):
    ids, ones, train = F.transform("x", lambda x, i: i), F.transform("x", lambda x: F.lit(1)), F.col("vec_id") % 2 == 1
    out = A.appended_response(ids, ones, F.col("logp"), ids, F.when(train, F.col("base")), train)
    df = tokens(spark, sf).select("vec_id", out.alias("o"))
    trained = F.aggregate("o.mask", F.lit(0), lambda a, m: a + m)
    return df.select("vec_id", F.size("o.tokens").alias("tokens"), trained.alias("trained"), r6(T.total(F.col("o.logprobs")), "total"))


@R.add("SELECT o_orderkey, [o_orderkey::INT % 256, 256 * (o_orderkey::INT % 256)] AS ids FROM orders")
def ta32_int32_array(spark, sf):
    byte = F.lpad(F.hex((k() % 256).cast("int")), 2, "0")
    packed = F.base64(F.unhex(F.concat(byte, F.lit("00000000"), byte, F.lit("0000"))))
    return table(spark, sf, "orders").select("o_orderkey", A.int32_array(packed).alias("ids"))


# pieces of rows that had no query of their own


@R.add(f"WITH {TOKENS} SELECT vec_id, round(sum(greatest(least(exp(logp-old),2.0),0.0)*mask),6) AS total FROM tok GROUP BY 1")
def ta19_truncated_weights(spark, sf):
    w, _ = T.importance_weights(F.col("logp"), F.col("old"), F.col("mask"), mode="truncate", high=2.0)
    return tokens(spark, sf).select("vec_id", r6(T.total(w), "total"))


@R.add("SELECT vec_id, (2*len(embedding)+1)::INT AS size, (2*len(embedding))::INT AS last, (2*len(embedding)+4)::INT AS padded FROM embeddings")
def ta29_merged_and_padded_spans(spark, sf):
    offsets = F.sequence(F.lit(0), F.size("embedding"))
    _, merged = T.merge_spans(F.col("embedding"), offsets, F.col("embedding"), offsets)
    padded = T.pad_spans(merged, 2 * F.size("embedding") + 3)
    return table(spark, sf, "embeddings").select("vec_id", F.size(merged).alias("size"), F.element_at(merged, -1).alias("last"), F.size(padded).alias("padded"))


@R.add("SELECT doc_id, list_filter(range(0, len(w)-1), lambda i: w[i+1]='the' AND w[i+2]='of')::INT[] AS positions FROM (SELECT doc_id, regexp_extract_all(lower(text),'[\\p{L}\\p{N}_]+') AS w FROM documents)")
def ta38_sublist_positions(spark, sf):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return table(spark, sf, "documents").select("doc_id", T.sublist_positions(w, F.array(F.lit("the"), F.lit("of"))).alias("positions"))


@R.add("SELECT vec_id, least((vec_id%7)::INT, len(embedding)) AS n FROM embeddings")
def ta39_common_prefix(spark, sf):
    e = F.col("embedding")
    other = F.transform(e, lambda x, i: F.when(i < F.col("vec_id") % 7, x).otherwise(x + 1))
    return table(spark, sf, "embeddings").select("vec_id", T.common_prefix(e, other).alias("n"))


@R.add("SELECT event_id, CASE event_id%4 WHEN 0 THEN 'truncated' WHEN 1 THEN 'aborted' WHEN 2 THEN 'completed' ELSE event_type END AS status FROM events")
def pf8_finish_status(spark, sf):
    from ..functions.text import finish_status

    n = F.col("event_id") % 4
    return table(spark, sf, "events").select("event_id", finish_status(F.when(n == 0, "length").when(n == 1, "abort").when(n == 2, "stop"), F.col("event_type")).alias("status"))


@R.add("SELECT vec_id, CASE WHEN vec_id%2=0 THEN (SELECT sum(CASE WHEN i%3=0 THEN 0 ELSE 1 END) FROM range(0,len(embedding)) t(i)) ELSE 9 END::BIGINT AS length FROM embeddings")
def pf15_effective_length(spark, sf):
    mask = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x, i: F.when(i % 3 == 0, 0).otherwise(1)))
    return table(spark, sf, "embeddings").select("vec_id", T.effective_length(mask, F.lit(9)).alias("length"))


#: Names of kernels, dealt to the parts in turn, and what each is.
SOME_KERNELS = {
    "ncclDevKernel_AllReduce": "NCCL Communication", "deep_ep::intranode::dispatch": "DeepEP Dispatch (MoE)", "deep_ep::Cached_notify": "DeepEP (other)", "flash_fwd_splitkv_attn": "Flash Attention", "cudnn_FMHA_bprop": "Attention (other)",
    "sm90_fp8_gemm_1d2d": "DeepGEMM (FP8)", "ampere_bf16_GEMM_relu": "GEMM/MatMul (other)", "per_token_group_quant_8bit": "Quantization (FP8)", "fused_add_rmsnorm": "Normalization", "triton_poi_fused_cat_1": "Fused/Triton Kernels",
    "vectorized_elementwise_kernel": "Elementwise Ops", "CatArrayBatchedCopy": "Concat/Cat", "indexSelectSmallIndex": "Index/Gather/Scatter", "radixSortKVInPlace": "Other Compute",
}


@R.add(f"WITH k AS (SELECT [{','.join(repr(k) for k in SOME_KERNELS)}] AS names, [{','.join(repr(k) for k in SOME_KERNELS.values())}] AS kinds) SELECT kinds[p_partkey%len(names)+1] AS category, count(*) AS n, sum(p_size)::BIGINT AS size FROM part, k GROUP BY 1")
def tx32_kernel_category(spark, sf):
    """Each part runs one of some kernels, under a name that its own name follows in brackets of a template."""
    names = F.array(*map(F.lit, SOME_KERNELS))
    kernel = F.concat(F.get(names, (F.col("p_partkey") % len(SOME_KERNELS)).cast("int")), F.lit("<"), F.regexp_replace("p_name", "[A-Za-z]", "0"), F.lit(">"))
    return table(spark, sf, "part").groupBy(P.kernel_category(kernel).alias("category")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@R.add(
    """WITH s AS (SELECT conv_id, turn, text, string_split(text, '. ') AS answers FROM conversations WHERE role='user'),
n AS (SELECT *, unnest(range(0,3)) AS k FROM s)
SELECT conv_id AS group_index, text AS prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k)-1 AS index, k::INT AS k, answers[(k%len(answers)+1)::INT] AS response, 'completed' AS status FROM n"""
)
def sc23_sampled_rows(spark, sf):
    """Each user's turn becomes three samples, its sentences being the stored answers."""
    c = table(spark, sf, "conversations").filter("role = 'user'").withColumn("answers", F.split("text", r"\. ", -1))
    return sampled_rows(c, "conv_id", "turn", "text", "answers", 3)


@R.add(
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag AS response, CASE WHEN l_orderkey%2=0 THEN 'N' ELSE 'R' END AS label, ['agreement','length_rank','surprise'][l_orderkey%3+1] AS scorer, l_shipdate FROM lineitem),
r AS (SELECT *, repeat(response, l_linenumber) AS said FROM g)
SELECT l_orderkey, l_linenumber, scorer, round(CASE scorer WHEN 'agreement' THEN count(*) OVER (PARTITION BY l_orderkey, response)/count(*) OVER (PARTITION BY l_orderkey) WHEN 'surprise' THEN CASE WHEN response=label THEN 1-avg((response=label)::INT) OVER (PARTITION BY l_orderkey) ELSE 0 END
 ELSE coalesce((rank() OVER (PARTITION BY l_orderkey ORDER BY length(response))-1)/nullif(count(*) OVER (PARTITION BY l_orderkey)-1,0),0) END,6) AS reward FROM r"""
)
def tx34_group_reward(spark, sf):
    """Lines of an order are a group whose order number names the scorer."""
    lines = table(spark, sf, "lineitem")
    # A task sorts what it gets, so a larger table is dealt to more tasks.
    tasks = max(spark.sparkContext.defaultParallelism, lines.count() // LINES_A_TASK + 1)
    g = lines.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("response")).repartition(tasks, "l_orderkey")
    g = g.withColumn("label", F.when(F.col("l_orderkey") % 2 == 0, "N").otherwise("R"))
    names = F.array(*map(F.lit, ["agreement", "length_rank", "surprise"]))
    g = g.withColumn("scorer", F.get(names, (F.col("l_orderkey") % 3).cast("int")))
    return group_rewards(g, "l_orderkey", "scorer", "response", "label").select("l_orderkey", "l_linenumber", "scorer", r6(F.col("reward"), "reward"))
