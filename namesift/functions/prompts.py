"""Prompts, chat templates and solutions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two questions about packages.
SYSTEM = {
    1: "You are a coding assistant that determines Python packages necessary to execute code. Respond with only a list of Python packages, separated by commas and no additional text or formatting. Your response must begin with the name of a Python package.",
    2: "You are a coding assistant that recommends Python packages that would be helpful to solve given problems. Respond with only a list of Python packages, separated by commas and no additional text or formatting. Your response must begin with the name of a Python package.",
}
PREFIX = {
    1: "Which Python packages are required to run this code:",
    2: "What Python packages would be useful in solving the following coding problem:",
}
#: Other wordings of the questions.
PREFIXES = {
    1: (
        "What Python packages are needed to run this code: ",
        "Which pip packages does this code require: ",
        "Name the Python packages this code depends on: ",
        "What packages would I need to pip install to run this: ",
        "Identify the Python package names required by this code: ",
        "What are the package dependencies for this code: ",
        "Which Python packages must be installed to execute this code: ",
        "List the package names needed to run the following code: ",
        "What packages does this code need installed to work: ",
        "Tell me which Python packages this code requires: ",
    ),
    2: (
        "Which Python packages would help solve this coding problem: ",
        "What Python packages could I use to tackle this problem: ",
        "Name some Python packages that would be relevant for solving this: ",
        "What packages should I consider using for this coding task: ",
        "Which Python packages would be appropriate for this problem: ",
        "What Python packages would you recommend for solving this: ",
        "Suggest Python packages that could help with this coding challenge: ",
        "What packages would be beneficial for implementing a solution to this: ",
        "Which Python packages are well-suited for this problem: ",
        "What Python packages would assist in solving the following task: ",
    ),
}
#: Wrappers of an instruction by part of the model's name, in order.
WRAPPERS = (
    ("deepseek", "{prompt}\n\n"),
    ("codellama", "[INST] {prompt} [/INST]\n"),
    ("mistral", "[INST] {prompt} [/INST]\n"),
    ("llama", "[INST] {prompt} [/INST]\n"),
    ("starchat", "<|system|>\n<|end|>\n<|user|>\n{prompt}<|end|>\n<|assistant|>\n"),
    ("wizardcoder", "Below is an instruction that describes a task.\n\n### Instruction:\n{prompt}\n\n### Response:\n"),
)
INSTRUCTION = "Complete the following Python function. Return ONLY the completed function body with no extra commentary.\n\n"


def prefix(mode: Column, key: Column, seed: int = 42) -> Column:
    """One of the wordings for a mode, chosen by a hash of seed and key."""
    pick = lambda m: F.element_at(F.array(*map(F.lit, PREFIXES[m])), (F.pmod(F.crc32(F.concat(F.lit(f"{seed}|"), key.cast("string"))), F.lit(len(PREFIXES[m]))) + 1).cast("int"))
    return F.when(mode == 1, pick(1)).when(mode == 2, pick(2))


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def question(system: Column, user: Column) -> Column:
    """The non-empty ones of both, with a blank line between."""
    return F.concat_ws("\n\n", F.nullif(system, F.lit("")), F.nullif(user, F.lit("")))


def chat(msgs: Column, family: str, generate: bool = False, bos: str = "") -> Column:
    """Messages (role, content) as one text in a family's template: llama3, qwen or deepseek."""
    body = lambda m: m["content"]
    if family == "llama3":
        one = lambda m: F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), body(m), F.lit("<|eot_id|>"))
        first = F.when(F.get(msgs, F.lit(0))["role"] != "system", F.lit("<|start_header_id|>system<|end_header_id|>\n\n<|eot_id|>")).otherwise("")
        ask = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    elif family == "qwen":
        one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), body(m), F.lit("<|im_end|>\n"))
        first, ask = F.lit(""), "<|im_start|>assistant\n"
    elif family == "deepseek":
        one = lambda m: F.when(m["role"] == "user", F.concat(F.lit("### Instruction:\n"), body(m), F.lit("\n"))).when(m["role"] == "assistant", F.concat(F.lit("### Response:\n"), body(m), F.lit("\n<|EOT|>\n"))).otherwise("")
        head = F.get(msgs, F.lit(0))
        first, ask = F.concat(F.lit(bos), F.when(head["role"] == "system", head["content"]).otherwise("")), "### Response:\n"
    else:
        raise ValueError(f"unknown family {family}")
    text = F.concat(F.coalesce(first, F.lit("")), F.array_join(F.transform(msgs, one), ""))
    return F.concat(text, F.lit(ask)) if generate else text


def family_of(model: str) -> str:
    """The template family by the model's name; llama3 where nothing else fits."""
    low = model.lower()
    return next((f for f in ("qwen", "deepseek") if f in low), "llama3")


def code_prompt(raw: Column, model: str) -> Column:
    """A completion request in the wrapper of the model's family; the bare prompt without one."""
    for key, wrapper in WRAPPERS:
        if key in model.lower():
            a, b = wrapper.split("{prompt}")
            return F.concat(F.lit(a + INSTRUCTION), raw, F.lit(b))
    return raw


def solution(raw: Column, completion: Column) -> Column:
    """The first fence's body (or the whole answer up to a fence), after the prompt unless it repeats the prompt's def line."""
    body = F.when(completion.contains("```"), F.regexp_replace(completion, r"(?s)^.*?```(?:python)?\n?", "")).otherwise(completion)
    code = F.substring_index(body, "```", 1)
    first = F.trim(F.get(F.split(F.trim(raw), "\n"), F.lit(0)))
    return F.when(first.startswith("def ") & code.contains(first), code).otherwise(F.concat(raw, code))
