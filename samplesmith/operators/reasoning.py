"""Reasoning enrichment of samples.

All transforms are single projections (plus the F4 filter): a narrow
scan -> filter -> project stage with no shuffle, so they also run unchanged
on a streaming DataFrame (see ``samplesmith.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.functions import rules as R
from samplesmith.functions import text as T
from samplesmith.functions import tools as TL

# ---------------------------------------------------------------------------
# Reasoning templates and prompt texts, as published.
# ---------------------------------------------------------------------------

STEPS_HEADER = "Let me analyze this step by step:\n1. Problem: "
STEP_TEMPLATES = {  # C12: class -> (approach, edge cases, implementation)
    "code_generation": ("Write clean, efficient code following best practices",
                        "Input validation, error handling, performance",
                        "Generate complete solution"),
    "bug_fix": ("Identify the bug and understand the root cause",
                "Test with various inputs",
                "Fix the issue while preserving existing functionality"),
    "explanation": ("Explain the code clearly with examples",
                    "Make it understandable for different skill levels",
                    "Provide comprehensive explanation"),
    "optimization": ("Identify performance bottlenecks",
                     "Ensure correctness is maintained",
                     "Optimize while keeping code readable"),
    "search": ("Find relevant code patterns",
               "Multiple matches, no matches",
               "Return best match"),
    "general": ("Generate appropriate solution",
                "Handle edge cases",
                "Complete the task"),
}

EXECUTION_TRACE_V2 = (
    "## Execution Trace\n```\n-> Initializing...\n-> Processing input...\n"
    "-> Generating output...\n-> Complete!\n```\n"
)
CODE_MARKERS = ("def ", "class ", "import ")

SYSTEM_PROMPT_V2 = """You are an expert coding assistant with Chain-of-Thought reasoning and tool-use capabilities.

## Available Tools
You have access to the following tools to help complete tasks:

### 1. python_executor
Execute Python code and get results.
```json
{"tool": "python_executor", "args": {"code": "print('hello')"}}
```

### 2. file_reader
Read contents from a file.
```json
{"tool": "file_reader", "args": {"path": "main.py", "lines": 50}}
```

### 3. file_writer
Write content to a file.
```json
{"tool": "file_writer", "args": {"path": "output.py", "content": "print('hello')"}}
```

### 4. web_search
Search for information online.
```json
{"tool": "web_search", "args": {"query": "python list comprehension"}}
```

## Chain-of-Thought Reasoning
When solving problems, think step by step:
1. Understand what needs to be done
2. Determine the approach
3. Consider edge cases  
4. Implement the solution

Always explain your reasoning before giving the final answer."""
TOOLS_HINT = "\n\nUse appropriate tools to complete this task."

COT_HEADER = "Let me analyze this problem step by step:\n"
COT_TRACE = "\nExecution trace:\n  -> Initializing...\n  -> Processing input...\n  -> Generating output...\n"
V1_TOOLS_INSTRUCTION = "Use Chain-of-Thought reasoning and available tools to complete this task."

MIN_OUTPUT_CHARS = 10  # F4

# ---------------------------------------------------------------------------

# C14's stricter trace test. (?d): only \n ends a line for '.', as in Python.
FENCED_PY_RE = "(?s)```python\n.*?```"
CODE_LINE_RE = "(?d)(def .+|class .+|import .+)"


def has_code_marker(output) -> Column:
    o = T.s(output)
    return o.contains(CODE_MARKERS[0]) | o.contains(CODE_MARKERS[1]) | o.contains(CODE_MARKERS[2])


def keep_output(output) -> Column:
    """drop samples whose output is empty or shorter than 10 characters."""
    o = T.col(output)
    return o.isNotNull() & (F.length(o) >= MIN_OUTPUT_CHARS)


def reasoning_steps(problem_type, instruction) -> Column:
    """C12 ``generate_reasoning_steps``: the class template with ``instruction[:100]``."""
    pt = T.col(problem_type)
    expr, general = None, None
    for cls, (approach, edge, impl) in STEP_TEMPLATES.items():
        tail = F.lit(f"\n2. Approach: {approach}\n3. Edge cases: {edge}\n4. Implementation: {impl}")
        expr = F.when(pt == cls, tail) if expr is None else expr.when(pt == cls, tail)
        general = tail if cls == "general" else general
    return F.concat(F.lit(STEPS_HEADER), T.head(T.s(instruction), 100), expr.otherwise(general))


def reasoning_output(instruction, output) -> Column:
    """C13 ``create_reasoning_output``."""
    o = T.s(output)
    steps = reasoning_steps(R.classify_problem(instruction), instruction)
    trace = F.when(has_code_marker(o), F.lit(EXECUTION_TRACE_V2)).otherwise(F.lit(""))
    return F.concat(F.lit("## Problem Analysis\n"), steps, F.lit("\n\n"), o, F.lit("\n\n"), trace)


def chain_of_thought(output, instruction, input_text) -> Column:
    """C14 ``add_chain_of_thought``."""
    o = T.s(output)
    trace = has_code_marker(o) & (o.rlike(FENCED_PY_RE) | o.rlike(CODE_LINE_RE))
    return F.concat(
        F.lit(COT_HEADER),
        F.lit("Step 1: Understand what needs to be done - "), R.summarize_problem(input_text),
        F.lit("\nStep 2: Determine the approach - "), R.generate_strategy(instruction),
        F.lit("\nStep 3: Consider edge cases - "), R.generate_consideration(instruction),
        F.lit("\nStep 4: Implement the solution\n\nBased on this reasoning:\n"),
        F.when(trace, F.lit(COT_TRACE)).otherwise(F.lit("")),
        F.lit("\n"), o,
    )


def transform_v1(df: DataFrame, add_cot: bool = True, add_tools: bool = True) -> DataFrame:
    """C15 ``transform_sample`` v1 over a DataFrame of samples (F4 first).

    Extra columns (e.g. ``seq``) pass through untouched.
    """
    i, x, o = T.s("instruction"), T.s("input"), T.s("output")
    new_output = chain_of_thought(o, i, x) if add_cot else o
    new_input, new_instruction = x, i
    if add_tools:
        new_input = F.concat(x, F.lit("\n\n## Available Tools\n```json\n" + TL.TOOL_CATALOGUE_JSON +
                                      "\n```\n\n## Your Task\n"), i)
        new_instruction = F.lit(V1_TOOLS_INSTRUCTION)
        if add_cot:
            new_output = F.concat(new_output, F.lit("\n\n## Tool Call\n```json\n"),
                                  TL.tool_call_json(i, x, o), F.lit("\n```"))
    return (df.where(keep_output("output"))
              .withColumns({"instruction": new_instruction, "input": new_input, "output": new_output}))


def transform_v2(df: DataFrame) -> DataFrame:
    """C16 ``transform_sample`` v2: F4, then C13 on the output."""
    return (df.where(keep_output("output"))
              .withColumns({"instruction": T.s("instruction"), "input": T.s("input"),
                            "output": reasoning_output("instruction", "output")}))


def transform_v2_tools(df: DataFrame, include_tools: bool = True) -> DataFrame:
    """C17 ``transform_sample_with_tools``: system prompt + task, tool hint, and a
    ``has_tools`` flag column (A8 counts it)."""
    flag = R.should_use_tools("instruction") if include_tools else F.lit(False)
    i, x = T.s("instruction"), T.s("input")
    return (df.where(keep_output("output"))
              .withColumn("has_tools", flag)
              .withColumns({
                  "instruction": F.concat(F.lit(SYSTEM_PROMPT_V2 + "\n\n## Task\n"), i),
                  "input": F.concat(x, F.when(F.col("has_tools"), F.lit(TOOLS_HINT)).otherwise(F.lit(""))),
                  "output": reasoning_output(i, "output"),
              }))
