"""Synthetic sample generators.

A generator maps each row id of a driving DataFrame to one sample; picks are
deterministic hash buckets of ``(seed, id)`` (the source is unseeded), so the
output is repeatable and partition-independent.  Lookups index literal arrays
(no join); the work is a single narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The category grid and example bank, as published.
# ---------------------------------------------------------------------------
CATEGORIES = [
    ("python", "Write a Python function to {task}", [
        "reverse a string", "check if a number is prime", "find the factorial of a number",
        "sort a list in ascending order", "find the maximum element in a list", "calculate the sum of a list",
        "check if a string is a palindrome", "remove duplicates from a list", "find the index of an element",
        "count occurrences of each element"]),
    ("python", "Implement a Python class for {task}", [
        "a stack data structure", "a queue data structure", "a linked list", "a binary search tree",
        "a caching system"]),
    ("python", "Fix the bug in this Python code", [
        "def divide(a, b): return a / b", "for i in range(10): print(i)", "def foo(l): return l[0]"]),
    ("python", "Optimize this Python code for performance", [
        "result = [x for x in range(1000) if x % 2 == 0]", "for i in range(len(l)): print(l[i])"]),
    ("javascript", "Write a JavaScript function to {task}", [
        "reverse an array", "check if a string is a palindrome", "find the maximum value", "remove duplicates"]),
    ("javascript", "Implement a JavaScript class for {task}", [
        "a simple counter", "a storage manager", "an event handler"]),
    ("java", "Write a Java method to {task}", [
        "reverse a string", "sort an array", "find the largest element"]),
    ("java", "Implement a Java class for {task}", [
        "a vehicle class", "a person class", "a bank account"]),
    ("kotlin", "Write a Kotlin function to {task}", [
        "reverse a string", "filter a list", "map values"]),
    ("kotlin", "Write a Kotlin coroutine for {task}", [
        "async data fetching", "parallel processing"]),
    ("general", "Explain what this code does", [
        "def foo(): return 42", "class Bar: pass", "import os"]),
    ("general", "Find performance issues in", [
        "nested loop code", "repeated database calls", "inefficient sorting"]),
]
PYTHON_BODIES = [
    "def solution():\n    pass",
    "def process(data):\n    return data",
    "class Handler:\n    def handle(self):\n        pass",
]
# language -> (input template, output); '{task}' is the task text.
LANGUAGE_IO = {
    "python": ("# {task}\n{body}", "# Implementation here\n"),
    "javascript": ("// {task}\nfunction process() {\n  // code here\n}", "// Implementation\n"),
    "java": ("// {task}\npublic void process() {\n    // code\n}", "// Implementation\n"),
    "kotlin": ("// {task}\nfun process() {\n    // code\n}", "// Implementation\n"),
    "general": ("# {task}", "# Explanation"),
}
EXAMPLE_BANK = [
    ("Write a function to reverse a string", "Create a function that reverses the input string",
     "def reverse_string(s): return s[::-1]"),
    ("Write a function to check if a number is prime", "Create a function that checks for primality",
     "def is_prime(n): return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))"),
    ("Write a function to find factorial", "Create a function that calculates factorial",
     "def factorial(n): return 1 if n <= 1 else n * factorial(n - 1)"),
    ("Explain what this code does", "def fetch_data(url): return requests.get(url).json()",
     "This function makes an HTTP GET request to the specified URL and returns the JSON response."),
    ("Find bugs in this code", "def divide(a, b): return a / b",
     "Bug: No check for division by zero. Add: if b == 0: raise ValueError('Cannot divide by zero')"),
    ("Write a Kotlin function to reverse a string", "Create a function that reverses a string in Kotlin",
     "fun reverseString(s: String) = s.reversed()"),
    ("Write a Jetpack Compose Composable", "Create a simple greeting Composable",
     "@Composable fun Greeting(name: String) { Text(\"Hello $name\") }"),
    ("Explain this Kotlin code", "val flow = flowOf(1, 2, 3).map { it * 2 }",
     "This creates a Kotlin Flow that emits 1, 2, 3 and transforms each value by multiplying by 2."),
    ("Create an Android ViewModel", "Create a ViewModel for a counter app",
     "class CounterViewModel : ViewModel() { private val _count = MutableLiveData(0); val count: LiveData get() = _count; fun increment() { _count.value = (_count.value ?: 0) + 1 } }"),
    ("Write a Retrofit API interface", "Create a Retrofit interface for fetching users",
     "interface UserApi { @GET(\"users/{id}\") suspend fun getUser(@Path(\"id\") id: Int): User }"),
]
VARIANT_PROMPTS = [
    ("Write a function to reverse a string", "def reverse_string(s):\n    return s[::-1]"),
    ("Write a function to check if a number is prime",
     "def is_prime(n):\n    if n < 2:\n        return False\n    for i in range(2, int(n**0.5) + 1):\n"
     "        if n % i == 0:\n            return False\n    return True"),
    ("Write a function to find the factorial", "def factorial(n):\n    if n <= 1:\n        return 1\n    return n * factorial(n - 1)"),
]
VARIANT_LANGUAGES = [
    ("JavaScript", "function add(a, b) { return a + b; }"),
    ("Java", "public static int add(int a, int b) { return a + b; }"),
    ("Go", "func add(a, b int) int { return a + b }"),
    ("Rust", "fn add(a: i32, b: i32) -> i32 { a + b }"),
]
VARIANT_REPEATS = 30
VARIANT_OUTPUT = "Correct implementation."
MAX_CHARS = 500
# ---------------------------------------------------------------------------


def bucket(id_col: str | Column, salt: str, n: int | Column, seed: int = 42) -> Column:
    """A deterministic pick in ``[0, n)`` for ``id`` (first 32 bits of an md5)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), c.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return h % n


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def template_grid(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """G1 ``generate_samples``: a category uniformly, then one of its tasks
    uniformly; input by language (Python picks one of three bodies); [:500]."""
    cat = bucket(id_col, "category", len(CATEGORIES), seed)
    tasks = F.array(*[_lits(ts) for _, _, ts in CATEGORIES])
    cat_tasks = F.element_at(tasks, (cat + 1).cast("int"))
    task = F.element_at(cat_tasks, (bucket(id_col, "task", F.size(cat_tasks), seed) + 1).cast("int"))
    lang = F.element_at(_lits([c for c, _, _ in CATEGORIES]), (cat + 1).cast("int"))
    tpl = F.element_at(_lits([t for _, t, _ in CATEGORIES]), (cat + 1).cast("int"))
    instruction = F.replace(tpl, F.lit("{task}"), task)
    body = F.element_at(_lits(PYTHON_BODIES), (bucket(id_col, "body", len(PYTHON_BODIES), seed) + 1).cast("int"))
    inp = None
    out = None
    for lang_name, (itpl, otext) in LANGUAGE_IO.items():
        a, rest = itpl.split("{task}")
        if "{body}" in rest:
            b, c = rest.split("{body}")
            val = F.concat(F.lit(a), task, F.lit(b), body, F.lit(c))
        else:
            val = F.concat(F.lit(a), task, F.lit(rest))
        inp = F.when(lang == lang_name, val) if inp is None else inp.when(lang == lang_name, val)
        out = F.when(lang == lang_name, F.lit(otext)) if out is None else out.when(lang == lang_name, F.lit(otext))
    return df.select(F.col(id_col).alias("id"), lang.alias("category"), instruction.alias("instruction"),
                     F.substring(inp, 1, MAX_CHARS).alias("input"), F.substring(out, 1, MAX_CHARS).alias("output"))


def example_bank(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """G2 ``generate_synthetic_data``: one of the ten examples uniformly."""
    k = (bucket(id_col, "example", len(EXAMPLE_BANK), seed) + 1).cast("int")
    return df.select(F.col(id_col).alias("id"),
                     F.element_at(_lits([e[0] for e in EXAMPLE_BANK]), k).alias("instruction"),
                     F.element_at(_lits([e[1] for e in EXAMPLE_BANK]), k).alias("input"),
                     F.element_at(_lits([e[2] for e in EXAMPLE_BANK]), k).alias("output"))


def variant_samples(spark: SparkSession) -> DataFrame:
    """3 prompts x 30 x (original, rewritten) + 4 languages x 30 = 300 rows,
    with ``seq`` in the source's order.  The rewrite is C27."""
    from samplesmith.operators.prompts import rewrite_identifiers
    n = VARIANT_REPEATS
    reps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(VARIANT_PROMPTS)], "p long, instruction string, code string")
    grid = p.select("*", reps)
    orig = grid.select((F.col("p") * n * 2 + F.col("rep") * 2).alias("seq"), "instruction",
                       F.col("code").alias("input"), F.lit(VARIANT_OUTPUT).alias("output"))
    var = grid.select((F.col("p") * n * 2 + F.col("rep") * 2 + 1).alias("seq"), "instruction",
                      rewrite_identifiers("code").alias("input"), F.lit(VARIANT_OUTPUT).alias("output"))
    base = len(VARIANT_PROMPTS) * n * 2
    lg = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(VARIANT_LANGUAGES)], "l long, lang string, code string")
    langs = lg.select("*", reps).select(
        (F.lit(base) + F.col("l") * n + F.col("rep")).alias("seq"),
        F.concat(F.lit("Write a function in "), F.col("lang")).alias("instruction"),
        F.col("code").alias("input"), F.concat(F.lit("Correct "), F.col("lang"), F.lit(" code.")).alias("output"))
    return orig.unionByName(var).unionByName(langs)
