"""Fields of samples: rewards, lengths, routing, invariants and teacher values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt_messages(prompt: Column) -> Column:
    """A plain prompt as one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def rendered_chat(messages: Column, generate: bool = True, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Messages (role, content) in a chat template, with the head of the answer that is to be generated."""
    said = F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(end + "\n")))
    return F.concat(F.array_join(said, ""), F.lit(f"{start}assistant\n" if generate else ""))


def dataset_row(prompt: Column, label: Column, metadata: Column, tools: Column | None = None) -> Column:
    """prompt (rendered), messages, label, tools and metadata of one raw row; null metadata is empty."""
    messages = prompt_messages(prompt)
    empty = F.create_map().cast("map<string,string>")
    return F.struct(rendered_chat(messages).alias("prompt"), messages.alias("messages"), label.cast("string").alias("label"), (tools if tools is not None else F.lit(None).cast("string")).alias("tools"), F.coalesce(metadata, empty).alias("metadata"))


def task_reward(*candidates: Column) -> Column:
    """The first that is a number; NaN isn't one."""
    return F.coalesce(*[F.when(~F.isnan(c), c) for c in candidates])


def keyed_reward(rewards: Column, key: Column | str) -> Column:
    return F.try_element_at(rewards, F.lit(key) if isinstance(key, str) else key)


def merged_metadata(base: Column, overrides: Column) -> Column:
    """Entries of both maps; overrides win. Null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    over, kept = F.coalesce(overrides, empty), F.coalesce(base, empty)
    return F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(over, k)), over)


def routed(candidates: list[Column], known: list[str], default: str) -> Column:
    """The first candidate that is known, else the default."""
    return F.coalesce(*[F.when(c.isin(*known), c) for c in candidates], F.lit(default))


def array_violations(mask: Column, logprobs: Column, length: Column, offsets: Column) -> Column:
    """Names of the arrays that don't fit the response length; a null array is none."""
    rules = {"loss_mask": F.size(mask) == length, "logprobs": F.size(logprobs) == length, "offsets": (F.size(offsets) == length + 1) & (F.get(offsets, F.lit(0)) == 0)}
    given = {"loss_mask": mask, "logprobs": logprobs, "offsets": offsets}
    return F.filter(F.array(*[F.when(given[n].isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda n: n.isNotNull())


def periodic(step: Column, interval: int, steps_an_epoch: int, total: int) -> Column:
    """Whether something is due after `step`: every `interval` steps, at the end of an epoch and at the very end."""
    return ((step + 1) % interval == 0) | ((step + 1) % steps_an_epoch == 0) | (step + 1 == total)


def masked_partial(mask: Column, partial: Column, response_length: Column) -> Column:
    """What an older policy began isn't trained."""
    return F.when(partial, F.array_repeat(F.lit(0), response_length)).otherwise(mask)


def teacher_tail(logprobs: Column, n: Column) -> Column:
    """The last `n` teacher values, the first of all left out; an error if there are fewer."""
    rest = F.slice(logprobs, 2, F.greatest(F.size(logprobs) - 1, F.lit(0)))
    tail = F.when(n == 0, F.slice(rest, 1, 0)).otherwise(F.slice(rest, F.greatest(F.size(rest) - n + 1, F.lit(1)), n))
    return F.when(F.size(rest) < n, F.raise_error(F.lit("too few teacher values")).cast("array<double>")).otherwise(tail)


# Parts of kernel names and their categories, in order of precedence.
# Categories of kernels in the order in which they are tried, and the parts that a name of each holds: all of one entry,
# which are joined by "+".
KERNELS = [
    ("NCCL Communication", ["nccl"]),
    ("DeepEP Dispatch (MoE)", ["deep_ep+dispatch"]),
    ("DeepEP Combine (MoE)", ["deep_ep+combine"]),
    ("DeepEP Buffer Clean", ["deep_ep+clean"]),
    ("DeepEP (other)", ["deep_ep"]),
    ("Flash Attention", ["flash+attn"]),
    ("Sparse Attention (MLA)", ["sparse_attn"]),
    ("Paged MQA/MLA Logits", ["paged_mqa"]),
    ("Attention (other)", ["attention", "fmha"]),
    ("DeepGEMM (FP8)", ["deep_gemm", "sm90_fp8_gemm"]),
    ("NvJet GEMM", ["nvjet"]),
    ("GEMM/MatMul (other)", ["gemm", "cutlass", "matmul", "cublas"]),
    ("TopK / MoE Routing", ["topk"]),
    ("Quantization (FP8)", ["quant"]),
    ("Normalization", ["norm"]),
    ("Fused/Triton Kernels", ["triton", "fused"]),
    ("Elementwise Ops", ["elementwise"]),
    ("Reduce/Softmax", ["reduce", "softmax"]),
    ("Embedding", ["embedding"]),
    ("Memory Ops", ["memcpy", "memset"]),
    ("Index/Gather/Scatter", ["index", "scatter", "gather"]),
    ("Concat/Cat", ["cat+batched"]),
]


def kernel_category(name: Column, ladder: list[tuple[str, list[str]]] = KERNELS, other: str = "Other Compute") -> Column:
    """The first category of which the name holds all parts of an entry, whatever their case."""
    said, out = F.lower(name), F.when(F.lit(False), other)
    for category, entries in ladder:
        holds = F.lit(False)
        for entry in entries:
            parts = F.lit(True)
            for part in entry.split("+"):
                parts = parts & F.contains(said, F.lit(part))
            holds = holds | parts
        out = out.when(holds, category)
    return out.otherwise(other)
