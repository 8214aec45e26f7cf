"""DuckDB SQL oracle for every registered query (same column names).

Built from the same fixed values as the Spark side, written independently as
SQL so the driver can check each Spark plan against it.
"""

from __future__ import annotations

from oracle.sqltext import (NL, after_first_newline, cascade, contains_any, first_line, first_nonempty, head,
                            head_lines, lit, nonempty, one_line, pick, s, strip, truthy)
from oracle.views import VIEWS
from samplesmith import adapters as A
from samplesmith.functions import rules as R
from samplesmith.functions import tools as TL
from samplesmith.operators import convert as CV
from samplesmith.operators import generate as G
from samplesmith.operators import prompts as PR
from samplesmith.operators import reasoning as RS
from samplesmith.operators import scoring as SC
from samplesmith.operators import snippets as SN
from samplesmith.sources.registry import DATASET_GROUPS

ORACLE: dict[str, str] = {}
NULLS = "CAST(NULL AS VARCHAR)"


def with_(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    ctes = [f"{v} AS ({VIEWS[v]})" for v in views]
    for k, v in (extra or {}).items():
        ctes.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- extra views (mirrors of the later adapters) ----------------------------------

VIEWS["v_code_doc"] = f"""
SELECT doc_id AS seq,
  'def f' || CAST(doc_id AS VARCHAR) || {lit('(x):' + chr(10) + '    return x * ')} || CAST(n_chars AS VARCHAR) AS code,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE {first_line('text')} END AS docstring,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE text END AS english_documentation,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE text END AS func_documentation_string,
  'def f' || CAST(doc_id AS VARCHAR) || {lit('(x):' + chr(10) + '    # ')} || CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS func_code_string,
  CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN '' ELSE source END AS repository_name,
  {pick(A.CODE_LANGS, f'doc_id % {len(A.CODE_LANGS)}')} AS lang,
  {pick(A.SPLITS, f'doc_id % {len(A.SPLITS)}')} AS split
FROM documents
"""

VIEWS["v_functions"] = f"""
SELECT item_id AS task_id,
  CASE WHEN item_id % 5 = 4 THEN '' ELSE 'def t' || CAST(item_id AS VARCHAR) || {lit('(x):' + chr(10) + '    """')} || {one_line('text')} || {lit('"""' + chr(10))} END AS prompt,
  CASE WHEN item_id % 6 = 5 THEN NULL ELSE '    return x + ' || CAST(item_id AS VARCHAR) END AS canonical_solution
FROM benchmark
"""

_RAWF = ["instruction", "input", "output", "prompt", "completion", "text", "code", "question", "solutions",
         "starter_code", "english_documentation", "func_documentation_string"]


def _named_part(k: int, name: str, src: str, cols: dict[str, str]) -> str:
    sel = ", ".join(f"{cols.get(f, NULLS)} AS {f}" for f in _RAWF)
    return f"SELECT {k} AS dataset_ord, {lit(name)} AS dataset, seq, {sel} FROM {src}"


VIEWS["v_named_sources"] = "\nUNION ALL\n".join([
    _named_part(0, A.NAMED_SOURCES[0], "(SELECT item_id AS seq, * FROM v_problems)",
                {f: f for f in ["question", "solutions", "starter_code"]}),
    _named_part(1, A.NAMED_SOURCES[1], "v_code_doc", {f: f for f in ["code", "english_documentation", "func_documentation_string"]}),
    _named_part(2, A.NAMED_SOURCES[2], "v_raw", {f: f for f in ["instruction", "input", "output"]}),
    _named_part(3, A.NAMED_SOURCES[3], "v_samples", {f: f for f in ["instruction", "input", "output"]}),
    _named_part(4, A.NAMED_SOURCES[4], "v_raw", {f: f for f in ["instruction", "input", "output"]}),
])
NAMED = ("v_problems", "v_code_doc", "v_raw", "v_samples", "v_named_sources")


# --- SQL mirrors of operators -------------------------------------------------------

def routed(src: str, fields: set[str], keep: str) -> str:
    """P1-P4 + F2 over ``src``."""
    f = lambda n: n if n in fields else NULLS
    pc = f"({f('prompt')} IS NOT NULL AND {f('completion')} IS NOT NULL)"
    tc = f"({f('text')} IS NOT NULL AND {f('code')} IS NOT NULL)"
    qs = f"({f('question')} IS NOT NULL AND {f('solutions')} IS NOT NULL)"
    p = s(f("prompt"))
    ins = f("instruction")
    instruction = (f"CASE WHEN {pc} THEN coalesce({nonempty(ins)}, {head(first_line(p), 200)}) "
                   f"WHEN {tc} THEN coalesce({ins}, {lit(CV.DEFAULT_TEXT_CODE_INSTRUCTION)}) "
                   f"WHEN {qs} THEN coalesce({ins}, {lit(CV.DEFAULT_QUESTION_INSTRUCTION)}) ELSE {s(ins)} END")
    inp = (f"CASE WHEN {pc} THEN (CASE WHEN contains({p}, {NL}) THEN {strip(after_first_newline(p))} ELSE {p} END) "
           f"WHEN {tc} THEN {s(f('text'))} WHEN {qs} THEN {s(f('question'))} ELSE {s(f('input'))} END")
    out = (f"CASE WHEN {pc} THEN {s(f('completion'))} WHEN {tc} THEN {s(f('code'))} "
           f"WHEN {qs} THEN {s(f('solutions'))} ELSE {s(f('output'))} END")
    return (f"SELECT {keep}, {instruction} AS instruction, {inp} AS input, {out} AS output FROM {src} "
            f"WHERE {truthy(ins)} OR {truthy(f('prompt'))}")


RAW_F = {"instruction", "input", "output", "prompt", "completion", "text", "code", "question", "solutions"}
SAMPLE_F = {"instruction", "input", "output"}
ROUTED_RAW = routed("v_raw", RAW_F, "seq, dataset")
ROUTED_SAMPLES = routed("v_samples", SAMPLE_F, "seq, dataset")


def keep_nonempty(src: str) -> str:
    return f"SELECT * FROM ({src}) WHERE {truthy('instruction')} OR {truthy('output')}"


def wide_key() -> str:
    return f"{s('instruction')} || {head(s('input'), 200)}"


def narrow_key() -> str:
    return f"{head(s('instruction'), 50)} || {head(s('input'), 100)}"


def keep_first(src: str, key: str, order: str) -> str:
    return f"SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


def parsed_solutions(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN json_valid({x}) AND json_type(CAST({x} AS JSON)) = 'ARRAY' "
            f"THEN from_json({x}, '[\"VARCHAR\"]') ELSE [{x}] END)")


def file_name(p: str = "path") -> str:
    return f"string_split({p}, '/')[-1]"


def parent_dirs(p: str = "path") -> str:
    return f"list_slice(string_split({p}, '/'), 1, len(string_split({p}, '/')) - 1)"


def extension(p: str = "path") -> str:
    return f"regexp_extract(regexp_replace({file_name(p)}, '^\\.+', ''), '\\.([^.]*)$', 1)"


def has_ext(exts, p: str = "path") -> str:
    return "(" + " OR ".join(f"ends_with({file_name(p)}, {lit(e)})" for e in exts) + ")"


def not_pruned(dirs, p: str = "path") -> str:
    return f"NOT list_has_any({parent_dirs(p)}, [{', '.join(lit(d) for d in dirs)}])"


def no_skip_word(words, p: str = "path") -> str:
    return "(" + " AND ".join(f"NOT contains({file_name(p)}, {lit(w)})" for w in words) + ")"


def byte_bound(lo, hi) -> str:
    c = ["TRUE"]
    if lo is not None:
        c.append(f"length > {lo}")
    if hi is not None:
        c.append(f"length < {hi}")
    return " AND ".join(c)


def chunks(src: str, window: int, max_lines: int | None = None, keep: str = "*") -> str:
    """Explode ``content`` of ``src`` into ``(chunk_no, chunk)`` windows."""
    upper = "len(lines)" if max_lines is None else f"least(len(lines), {max_lines})"
    return (f"SELECT {keep}, CAST(st // {window} AS INTEGER) AS chunk_no, "
            f"array_to_string(list_slice(lines, st + 1, st + {window}), {NL}) AS chunk FROM "
            f"(SELECT *, unnest(generate_series(0, {upper} - 1, {window})) AS st FROM "
            f"(SELECT *, string_split(content, {NL}) AS lines FROM ({src})))")


def tree_chunks(src: str) -> str:
    f = f"SELECT * FROM ({src}) WHERE length(content) >= 50 AND length(content) <= 50000"
    return f"SELECT * FROM ({chunks(f, 40)}) WHERE length({strip('chunk')}) > 20"


def fanout(src: str) -> str:
    ext = extension("path")
    hint = f"(CASE WHEN {ext} <> '' THEN ' (' || {ext} || ' code)' ELSE '' END)"
    parts = []
    for k, t in enumerate(SN.TASKS):
        ins = f"{lit(t)} || {hint}" if k == 0 else lit(t)
        parts.append(f"SELECT path, chunk_no, {k} AS task_no, {ins} AS instruction, chunk AS input, '' AS output FROM ({src})")
    return " UNION ALL ".join(parts)


def snippets(src_view: str, sc) -> str:
    f = (f"SELECT * FROM {src_view} WHERE {byte_bound(sc.min_bytes, sc.max_bytes)} AND {has_ext(sc.exts)} "
         f"AND {not_pruned(sc.pruned_dirs)} QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= {sc.files_per_repo}")
    ext = extension("path")

    def fill(tpl):
        if "{ext}" not in tpl:
            return lit(tpl)
        a, b = tpl.split("{ext}")
        return f"{lit(a)} || {ext} || {lit(b)}"
    return (f"SELECT repo, path, {fill(sc.instruction)} AS instruction, {head('snippet', sc.chars)} AS input, "
            f"{fill(sc.output)} AS output FROM (SELECT repo, path, {head_lines('content', sc.lines)} AS snippet FROM ({f})) "
            f"WHERE length(snippet) > 100")


def code_expr_relation(src: str, text: str = "text", lang: str = "python", out: str = "code") -> str:
    """``src`` plus an ``out`` column = C22 ``extract_code`` of ``text``."""
    t = s(text)
    fence = []
    for tag in SC.LANG_TAGS.get(lang, SC.DEFAULT_TAGS):
        rest = f"substr({t}, strpos({t}, {lit(tag)}) + {len(tag)})"
        rel = f"strpos({rest}, '```')"
        fence.append(f"WHEN strpos({t}, {lit(tag)}) > 0 AND {rel} > 1 THEN {strip(f'substr({rest}, 1, {rel} - 1)')}")
    keep_line = (f"NOT toggles[i] AND len(list_filter(tpos, lambda p: p < i)) % 2 = 0 AND length(stripped[i]) > 0 "
                 f"AND NOT starts_with(stripped[i], '#') AND NOT starts_with(stripped[i], '//')")
    fb = (f"array_to_string(list_transform(list_slice(list_filter(range(1, len(lines) + 1), lambda i: {keep_line}), 1, 100), "
          f"lambda i: lines[i]), {NL})")
    q1, q2 = lit('"""'), lit("'''")
    return (f"SELECT * EXCLUDE (lines, stripped, toggles, tpos), CASE {' '.join(fence)} ELSE {fb} END AS {out} FROM "
            f"(SELECT *, list_filter(range(1, len(lines) + 1), lambda i: toggles[i]) AS tpos FROM "
            f"(SELECT *, list_transform(stripped, lambda x: starts_with(x, {q1}) OR starts_with(x, {q2})) AS toggles FROM "
            f"(SELECT *, list_transform(lines, lambda l: {strip('l')}) AS stripped FROM "
            f"(SELECT *, string_split({t}, {NL}) AS lines FROM ({src})))))")


GENS_CODE = code_expr_relation("SELECT * FROM v_generations")


def per_problem(src: str) -> str:
    return f"""SELECT * FROM
 (SELECT benchmark, model, task_id, CAST(count_if(passed) AS BIGINT) AS num_passed, bool_or(passed) AS passed,
         count(*) AS total FROM ({src}) GROUP BY ALL) agg
 JOIN (SELECT benchmark, model, task_id, list(substr(coalesce(code, ''), 1, 200) ORDER BY gen) AS first_codes,
              list(passed ORDER BY gen) AS first_passed
       FROM (SELECT * FROM ({src}) QUALIFY row_number() OVER (PARTITION BY benchmark, model, task_id ORDER BY gen) <= 3)
       GROUP BY ALL) subs USING (benchmark, model, task_id)"""


def classify(x: str) -> str:
    return cascade(x, R.PROBLEM_CLASSES, R.PROBLEM_CLASS_DEFAULT)


def summarize(x: str, n: int, empty: str) -> str:
    return f"(CASE WHEN {truthy(x)} THEN {strip(one_line(head(x, n)))} ELSE {lit(empty)} END)"


def steps(instruction: str) -> str:
    cls = classify(instruction)
    tails = " ".join(
        f"WHEN {cls} = {lit(k)} THEN {lit(chr(10) + '2. Approach: ' + a + chr(10) + '3. Edge cases: ' + e + chr(10) + '4. Implementation: ' + i)}"
        for k, (a, e, i) in RS.STEP_TEMPLATES.items())
    return f"({lit(RS.STEPS_HEADER)} || {head(s(instruction), 100)} || (CASE {tails} END))"


def code_marker(o: str) -> str:
    return "(" + " OR ".join(f"contains({o}, {lit(m)})" for m in RS.CODE_MARKERS) + ")"


def reasoning_output(instruction: str, output: str) -> str:
    o = s(output)
    return (f"('## Problem Analysis' || {NL} || {steps(instruction)} || {lit(chr(10) * 2)} || {o} || {lit(chr(10) * 2)} || "
            f"(CASE WHEN {code_marker(o)} THEN {lit(RS.EXECUTION_TRACE_V2)} ELSE '' END))")


def chain_of_thought(output: str, instruction: str, inp: str) -> str:
    o = s(output)
    fenced = f"regexp_matches({o}, {lit('```python' + chr(10))} || '(?s:.*?)```')"
    line = f"regexp_matches({o}, '(def .+|class .+|import .+)')"
    trace = f"({code_marker(o)} AND ({fenced} OR {line}))"
    return (f"({lit(RS.COT_HEADER)} || 'Step 1: Understand what needs to be done - ' || "
            f"{summarize(inp, 100, R.PROBLEM_SUMMARY_EMPTY)} || {lit(chr(10) + 'Step 2: Determine the approach - ')} || "
            f"{cascade(instruction, R.STRATEGIES, R.STRATEGY_DEFAULT)} || {lit(chr(10) + 'Step 3: Consider edge cases - ')} || "
            f"{cascade(instruction, R.CONSIDERATIONS, R.CONSIDERATION_DEFAULT)} || "
            f"{lit(chr(10) + 'Step 4: Implement the solution' + chr(10) + chr(10) + 'Based on this reasoning:' + chr(10))} || "
            f"(CASE WHEN {trace} THEN {lit(RS.COT_TRACE)} ELSE '' END) || {NL} || {o})")


def file_path_sql(x: str) -> str:
    x = s(x)
    return (f"coalesce(nullif(regexp_extract({x}, {lit(TL.PATH_QUOTED_RE)}, 1), ''), "
            f"nullif(regexp_extract({x}, {lit(TL.PATH_BARE_RE)}, 1), ''))")


def pattern_sql(x: str) -> str:
    first = f"nullif(regexp_extract({s(x)}, {lit(TL.FIRST_WORD_RE)}, 1), '')"
    return f"(CASE WHEN {first} IS NOT NULL THEN 'def ' || {first} ELSE {lit(TL.DEFAULT_PATTERN)} END)"


def github_sql(x: str) -> str:
    x = s(x)
    gh = f"nullif(regexp_extract({x}, {lit(TL.GITHUB_RE)}, 0), '')"
    url = f"nullif(regexp_extract({x}, {lit(TL.URL_RE)}, 0), '')"
    return (f"(CASE WHEN {gh} IS NOT NULL THEN 'https://' || {gh} "
            f"WHEN {url} IS NOT NULL AND contains(lower({url}), 'github') THEN {url} END)")


def json_string_sql(x: str) -> str:
    """A JSON string literal as Python's json.dumps writes it (ensure_ascii)."""
    u = "unicode(ch)"
    short = " ".join(f"WHEN ch = {raw} THEN {lit(out)}" for raw, out in [
        ("'\"'", '\\"'), ("'\\'", "\\\\"), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t"),
        ("chr(8)", "\\b"), ("chr(12)", "\\f")])
    esc = (f"CASE {short} WHEN {u} BETWEEN 32 AND 126 THEN ch "
           f"WHEN {u} > 65535 THEN '\\u' || printf('%04x', 55296 + (({u} - 65536) >> 10)) || '\\u' || "
           f"printf('%04x', 56320 + (({u} - 65536) & 1023)) "
           f"ELSE '\\u' || printf('%04x', {u}) END")
    body = (f"CASE WHEN regexp_matches({x}, '^[ !#-\\[\\]-~]*$') THEN {x} ELSE "
            f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda ch: {esc}), '') END")
    return f"('\"' || ({body}) || '\"')"


def tool_call_sql(instruction: str, inp: str, output: str) -> str:
    i, x, o = s(instruction), s(inp), s(output)

    def call(tool, *kv):
        parts = [lit('{"tool": "' + tool + '", "args": {')]
        for k, (key, v) in enumerate(kv):
            parts.append(lit((", " if k else "") + '"' + key + '": '))
            parts.append(f"CAST({v} AS VARCHAR)" if key == "lines" else json_string_sql(v))
        parts.append(lit("}}"))
        return "(" + " || ".join(parts) + ")"
    return (f"(CASE WHEN {contains_any(i, TL.WEB_WORDS)} THEN "
            f"{call('web_search', ('query', f'CASE WHEN {truthy(x)} THEN {head(x, 100)} ELSE {i} END'))} "
            f"WHEN {contains_any(i, TL.READ_WORDS)} THEN "
            f"{call('file_reader', ('path', f'coalesce({file_path_sql(x)}, {lit(TL.DEFAULT_READ_PATH)})'), ('lines', str(TL.READ_LINES)))} "
            f"WHEN {contains_any(i, TL.WRITE_WORDS)} THEN "
            f"{call('file_writer', ('path', lit(TL.WRITE_PATH)), ('content', head(o, 200)))} "
            f"WHEN {contains_any(i, TL.SEARCH_WORDS)} THEN "
            f"{call('code_search', ('pattern', pattern_sql(i)), ('path', lit(TL.SEARCH_PATH)))} "
            f"WHEN {contains_any(i, TL.CLONE_WORDS)} THEN "
            f"{call('git_clone', ('repo_url', f'coalesce({github_sql(x)}, {lit(TL.DEFAULT_REPO_URL)})'))} "
            f"ELSE {call('python_executor', ('code', f'CASE WHEN {truthy(o)} THEN {head(o, 200)} ELSE {lit(TL.EMPTY_CODE)} END'))} END)")


def keep_output(o: str = "output") -> str:
    return f"({o} IS NOT NULL AND length({o}) >= {RS.MIN_OUTPUT_CHARS})"


def transform_v1(src: str) -> str:
    i, x, o = s("instruction"), s("input"), s("output")
    new_out = (f"{chain_of_thought(o, i, x)} || {lit(chr(10) * 2 + '## Tool Call' + chr(10) + '```json' + chr(10))} || "
               f"{tool_call_sql(i, x, o)} || {lit(chr(10) + '```')}")
    new_in = f"{x} || {lit(chr(10) * 2 + '## Available Tools' + chr(10) + '```json' + chr(10) + TL.TOOL_CATALOGUE_JSON + chr(10) + '```' + chr(10) * 2 + '## Your Task' + chr(10))} || {i}"
    return (f"SELECT seq, dataset, {lit(RS.V1_TOOLS_INSTRUCTION)} AS instruction, {new_in} AS input, {new_out} AS output "
            f"FROM {src} WHERE {keep_output()}")


def transform_v2(src: str) -> str:
    return (f"SELECT seq, dataset, {s('instruction')} AS instruction, {s('input')} AS input, "
            f"{reasoning_output('instruction', 'output')} AS output FROM {src} WHERE {keep_output()}")


def transform_tools(src: str) -> str:
    flag = contains_any(s("instruction"), R.TOOL_KEYWORDS)
    return (f"SELECT seq, dataset, {flag} AS has_tools, {lit(RS.SYSTEM_PROMPT_V2 + chr(10) * 2 + '## Task' + chr(10))} || {s('instruction')} AS instruction, "
            f"{s('input')} || (CASE WHEN {flag} THEN {lit(RS.TOOLS_HINT)} ELSE '' END) AS input, "
            f"{reasoning_output('instruction', 'output')} AS output FROM {src} WHERE {keep_output()}")


def fill_template(tpl: str, **cols: str) -> str:
    parts, rest = [], tpl
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            parts.append(lit(pre))
        parts.append(s(cols[name]))
    if rest:
        parts.append(lit(rest))
    return "(" + " || ".join(parts) + ")"


def render(style: str) -> str:
    t = PR.PROMPT_TEMPLATES.get(style, PR.PROMPT_TEMPLATES["inst"])
    return fill_template(t, instruction="instruction", input="input", output="output")


def split_bucket(idc: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5('split{seed}:' || CAST({idc} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


def bucket(idc: str, salt: str, n: str, seed: int = 42) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:{salt}:' || CAST({idc} AS VARCHAR)), 1, 8)) AS BIGINT) % {n})"


def fixed_length(tokens: str, max_seq: int) -> dict[str, str]:
    t = f"list_slice({tokens}, 1, {max_seq})"
    ids = f"list_resize({t}, {max_seq}, 0)"
    mask = f"list_resize(list_transform({t}, lambda x: 1), {max_seq}, 0)"
    return {"input_ids": ids, "attention_mask": mask, "labels": ids}


def thread_samples(max_items: int | None) -> str:
    lim = f"LIMIT {max_items}" if max_items else ""
    lim2 = f"LIMIT {max_items // 2}" if max_items else ""
    issues = f"SELECT * FROM (SELECT * FROM v_thread_items ORDER BY item_id {lim}) WHERE pull_request IS NULL"
    prs = f"SELECT * FROM v_thread_items WHERE pull_request IS NOT NULL ORDER BY item_id {lim2}"
    kept = f"SELECT 0 AS kind, * FROM ({issues}) UNION ALL SELECT 1 AS kind, * FROM ({prs})"
    tb = f"'Title: ' || {s('title')} || {lit(chr(10) * 2)} || {s('body')}"
    items = (f"SELECT kind, item_id, CAST(-1 AS BIGINT) AS ord, CASE WHEN kind = 0 THEN {lit(CV.ISSUE_INSTRUCTION)} "
             f"ELSE {lit(CV.PR_INSTRUCTION)} END AS instruction, {tb} AS input, '' AS output FROM kept")
    comments = (f"SELECT k.kind, c.parent_key AS item_id, CAST(c.ord AS BIGINT) AS ord, {lit(CV.COMMENT_INSTRUCTION)} AS instruction, "
                f"{s('c.body')} AS input, '' AS output FROM (SELECT * FROM v_thread_comments QUALIFY row_number() OVER "
                f"(PARTITION BY parent_key ORDER BY ord) <= 5) c JOIN kept k ON k.item_id = c.parent_key")
    return with_(f"{items} UNION ALL {comments}", "v_thread_items", "v_thread_comments", extra={"kept": kept})


# --- the queries ---------------------------------------------------------------------

ORACLE["flagship_class_profile"] = with_(
    f"SELECT {classify('instruction')} AS problem_class, count(*) AS samples, round(avg(length(output)), 6) AS avg_output_chars "
    f"FROM ({keep_first(keep_nonempty(ROUTED_SAMPLES), wide_key(), 'seq')}) GROUP BY 1", "v_samples")

ORACLE["p1_p4_routed_normalize"] = with_(ROUTED_RAW, "v_raw")

ORACLE["p5_problem_samples"] = with_(f"""
SELECT item_id, 0 AS sample_no, {lit(CV.APPS_SOLVE)} AS instruction, {s('question')} AS input, {s('sols[1]')} AS output
FROM p WHERE len(sols) > 0
UNION ALL
SELECT item_id, CASE WHEN len(sols) > 0 THEN 1 ELSE 0 END, {lit(CV.APPS_STARTER)},
  'Problem:' || {NL} || {s('question')} || {lit(chr(10) * 2 + 'Starter code:' + chr(10))} || starter_code, ''
FROM p WHERE {truthy('starter_code')}""", "v_problems",
    extra={"p": f"SELECT *, {parsed_solutions('solutions')} AS sols FROM v_problems"})

_cd_code = first_nonempty("func_documentation_string", "code")
ORACLE["p6_code_doc_explain"] = with_(
    f"SELECT seq, {lit(CV.EXPLAIN_WITH_DOC)} AS instruction, 'Documentation:' || {NL} || {s('english_documentation')} || "
    f"{lit(chr(10) * 2 + 'Code:' + chr(10))} || {_cd_code} AS input, '' AS output FROM v_code_doc "
    f"WHERE {truthy(_cd_code)} AND {truthy(s('english_documentation'))}", "v_code_doc")

ORACLE["p7_p8_instruction_passthrough"] = with_(
    f"SELECT seq, {s('instruction')} AS instruction, {s('input')} AS input, {s('output')} AS output FROM v_raw "
    f"WHERE {truthy('instruction')}", "v_raw")

ORACLE["p9_function_completion"] = with_(
    f"SELECT task_id, {lit(CV.HUMANEVAL_COMPLETE)} AS instruction, {s('prompt')} AS input, {s('canonical_solution')} AS output "
    f"FROM v_functions WHERE {truthy('prompt')} AND {truthy('canonical_solution')}", "v_functions")

ORACLE["p10_function_writing"] = with_(
    f"SELECT seq, {lit(CV.MBPP_WRITE)} AS instruction, {s('text')} AS input, {s('code')} AS output FROM v_raw "
    f"WHERE {truthy('text')} AND {truthy('code')}", "v_raw")


def _route_sql() -> str:
    name = "lower(dataset)"
    apps = f"contains({name}, 'apps')"
    csn = f"(NOT {apps} AND contains({name}, 'codesearchnet'))"
    other = f"(NOT {apps} AND NOT contains({name}, 'codesearchnet'))"
    p = f"(SELECT *, {parsed_solutions('solutions')} AS sols FROM v_named_sources)"
    return f"""
SELECT dataset_ord, dataset, seq, 0 AS sample_no, {lit(CV.APPS_SOLVE)} AS instruction, {s('question')} AS input, {s('sols[1]')} AS output
FROM {p} WHERE {apps} AND len(sols) > 0
UNION ALL
SELECT dataset_ord, dataset, seq, CASE WHEN len(sols) > 0 THEN 1 ELSE 0 END, {lit(CV.APPS_STARTER)},
  'Problem:' || {NL} || {s('question')} || {lit(chr(10) * 2 + 'Starter code:' + chr(10))} || starter_code, ''
FROM {p} WHERE {apps} AND {truthy('starter_code')}
UNION ALL
SELECT dataset_ord, dataset, seq, 0, {lit(CV.EXPLAIN_WITH_DOC)}, 'Documentation:' || {NL} || {s('english_documentation')} ||
  {lit(chr(10) * 2 + 'Code:' + chr(10))} || {_cd_code}, ''
FROM v_named_sources WHERE {csn} AND {truthy(_cd_code)} AND {truthy(s('english_documentation'))}
UNION ALL
SELECT dataset_ord, dataset, seq, 0, {s('instruction')}, {s('input')}, {s('output')}
FROM v_named_sources WHERE {other} AND {truthy('instruction')}"""


ROUTE_SQL = _route_sql()
ORACLE["p11_route_by_file_name"] = with_(ROUTE_SQL, *NAMED)

_first = s("sols[1]")
P12 = (f"SELECT item_id, 'Solve this coding problem (Difficulty: ' || {s('difficulty')} || ').' AS instruction, "
       f"{head(s('question'), 800)} AS input, {head(_first, 800)} AS output "
       f"FROM (SELECT *, {parsed_solutions('solutions')} AS sols FROM v_problems) "
       f"WHERE {truthy(s('question'))} AND {truthy(_first)}")
ORACLE["p12_problem_difficulty"] = with_(P12, "v_problems")

_p = s("prompt")
ORACLE["p13_alpaca_hub"] = with_(
    f"SELECT * FROM (SELECT seq, CASE WHEN {truthy(_p)} THEN {head(first_line(_p), 200)} ELSE {lit(CV.ALPACA_DEFAULT)} END AS instruction, "
    f"CASE WHEN contains({_p}, {NL}) THEN {head(strip(after_first_newline(_p)), 500)} ELSE {head(_p, 500)} END AS input, "
    f"{head(s('completion'), 500)} AS output FROM v_raw) WHERE {truthy('instruction')}", "v_raw")

ORACLE["p14_humaneval_hub"] = with_(
    f"SELECT task_id, {lit(CV.HUMANEVAL_SHORT)} AS instruction, {head(s('prompt'), 500)} AS input, "
    f"{head(s('canonical_solution'), 500)} AS output FROM v_functions", "v_functions")

ORACLE["p15_mbpp_hub"] = with_(
    f"SELECT seq, {lit(CV.MBPP_SHORT)} AS instruction, {head(s('text'), 500)} AS input, {head(s('code'), 500)} AS output "
    f"FROM v_raw", "v_raw")

P16 = (f"SELECT * FROM (SELECT seq, {head(s('instruction'), 200)} AS instruction, {head(s('input'), 500)} AS input, "
       f"{head(s('output'), 500)} AS output FROM v_raw) WHERE {truthy('instruction')}")
ORACLE["p16_python_instruct_hub"] = with_(P16, "v_raw")


def _fne(src: str, i, x, o) -> str:
    fi, fx, fo = first_nonempty(*i), first_nonempty(*x), first_nonempty(*o)
    return (f"SELECT seq, dataset, {head(fi, 200)} AS instruction, {head(fx, 500)} AS input, {head(fo, 500)} AS output "
            f"FROM (SELECT *, {NULLS} AS solution, {NULLS} AS answer FROM {src}) WHERE {truthy(fi)} AND {truthy(fo)}")


P17_COLS = (("instruction", "prompt", "question"), ("input", "text", "code"), ("output", "solution", "completion", "answer"))
ORACLE["p17_first_nonempty_a"] = with_(_fne("v_raw", *P17_COLS), "v_raw")
ORACLE["p18_first_nonempty_b"] = with_(_fne("v_raw", ("instruction", "prompt", "question"), ("input", "text"),
                                            ("output", "completion", "solution")), "v_raw")

_doc19 = first_nonempty("docstring", "english_documentation")
ORACLE["p19_code_docstring"] = with_(
    f"SELECT seq, 'Explain this python code with its documentation.' AS instruction, {head(s('code'), 600)} AS input, "
    f"{head(_doc19, 400)} AS output FROM v_code_doc WHERE {truthy('code')} AND {truthy(_doc19)}", "v_code_doc")

ORACLE["p20_function_doc_short"] = with_(
    f"SELECT * FROM (SELECT seq, {lit(CV.CODESEA_SHORT)} AS instruction, {head(s('func_code_string'), 500)} AS input, "
    f"{head(s('func_documentation_string'), 300)} AS output FROM v_code_doc) "
    f"WHERE {truthy('input')} AND {truthy('output')} AND length(input) > 50", "v_code_doc")

ORACLE["p21_function_doc_multilang"] = with_(
    f"SELECT seq, lang, split, 'Explain this ' || lang || ' code:' AS instruction, {head(s('func_code_string'), 2000)} AS input, "
    f"CASE WHEN {truthy('func_documentation_string')} THEN {head('func_documentation_string', 500)} "
    f"ELSE 'Function from ' || coalesce(repository_name, 'codebase') END AS output FROM v_code_doc "
    f"WHERE {truthy(s('func_code_string'))} AND length({s('func_code_string')}) > 50", "v_code_doc")

_tb = f"'Title: ' || {s('title')} || {lit(chr(10) * 2)} || {s('body')}"
ORACLE["p22_issue_samples"] = with_(
    f"SELECT item_id, {lit(CV.ISSUE_INSTRUCTION)} AS instruction, {_tb} AS input, '' AS output FROM v_thread_items "
    f"WHERE pull_request IS NULL", "v_thread_items")
ORACLE["p23_pr_samples"] = with_(
    f"SELECT item_id, {lit(CV.PR_INSTRUCTION)} AS instruction, {_tb} AS input, '' AS output FROM v_thread_items "
    f"WHERE pull_request IS NOT NULL", "v_thread_items")
ORACLE["p24_comment_samples"] = with_(
    f"SELECT parent_key, ord, {lit(CV.COMMENT_INSTRUCTION)} AS instruction, {s('body')} AS input, '' AS output "
    f"FROM v_thread_comments", "v_thread_comments")
ORACLE["p25_discussion_samples"] = with_(
    f"SELECT item_id, {lit(CV.DISCUSSION_INSTRUCTION)} AS instruction, 'Title: ' || {s('title')} || "
    f"{lit(chr(10) * 2 + 'Discussion: ')} || {head(s('body'), 500)} AS input, {lit(CV.DISCUSSION_OUTPUT)} AS output "
    f"FROM v_thread_items WHERE length({s('body')}) > 50", "v_thread_items")

for _k, _sc in SN.SNIPPET_SOURCES.items():
    ORACLE[f"p26{_k}_repo_snippets"] = with_(snippets("v_files", _sc), "v_files")

TREE_CHUNKS = tree_chunks("SELECT path, content FROM v_files")
ORACLE["p27_task_fanout"] = with_(fanout(TREE_CHUNKS), "v_files")
ORACLE["p28a_tree_chunks"] = with_(f"SELECT path, chunk_no, chunk FROM ({TREE_CHUNKS})", "v_files")
ORACLE["p28b_min_chunks"] = with_(
    f"SELECT path, chunk_no, chunk FROM ({chunks('SELECT path, content FROM v_files', 30)}) "
    f"WHERE length({strip('chunk')}) > 20", "v_files")

_segs = parent_dirs("path")
_py_files = (f"SELECT repo, path, content FROM v_files WHERE ends_with({file_name()}, '.py') "
             f"AND {not_pruned(SN.PY_TREE_PRUNED)} AND len(list_filter({_segs}, lambda d: starts_with(d, '.'))) = 0")
ORACLE["p29_line_provenance_chunks"] = with_(
    f"SELECT repo, path, chunk_no, 'Explain this code from corpus (' || path || ', lines ' || CAST(chunk_no * 20 + 1 AS VARCHAR) "
    f"|| '-' || CAST(chunk_no * 20 + 20 AS VARCHAR) || '):' AS instruction, chunk AS input, "
    f"'The code implements corpus functionality.' AS output FROM ({chunks(_py_files, 20, 80)}) WHERE length(chunk) > 100",
    "v_files")

ORACLE["p30_report_truncation"] = with_(
    f"SELECT benchmark, model, task_id, gen, substr('Solve task ' || CAST(task_id AS VARCHAR), 1, 50) AS instruction, "
    f"{head(s('text'), 200)} AS generated, {head(s('code'), 200)} AS extracted_code, length({s('code')}) > 0 AS has_code, "
    f"({truthy('code')} AND coalesce(passed, FALSE)) AS passed, "
    f"CASE WHEN {truthy('code')} THEN {head(s('error'), 100)} END AS error "
    f"FROM ({GENS_CODE}) WHERE benchmark = 'custom'", "v_generations")

ORACLE["p31_dataset_kind"] = with_(
    "SELECT path, CASE WHEN contains(n, 'cot') THEN 'cot' WHEN contains(n, 'reasoning') THEN 'reasoning' ELSE 'standard' END AS kind "
    "FROM (SELECT path, string_split(repo || '/' || CASE WHEN length % 3 = 0 THEN 'cot_' WHEN length % 3 = 1 THEN 'reasoning_' "
    "ELSE '' END || 'data.jsonl', '/')[-1] AS n FROM v_files)", "v_files")

# --- filters ----------------------------------------------------------------------
ORACLE["f2_validate_raw"] = with_(f"SELECT seq FROM v_raw WHERE {truthy('instruction')} OR {truthy('prompt')}", "v_raw")
ORACLE["f3_nonempty_samples"] = with_(f"SELECT seq FROM ({keep_nonempty(ROUTED_RAW)})", "v_raw")
ORACLE["f4_output_length"] = with_(f"SELECT seq FROM v_samples WHERE {keep_output()}", "v_samples")
ORACLE["f5_f7_tree_file_filters"] = with_(
    f"SELECT path FROM v_files WHERE {has_ext(SN.TREE_EXTS)} AND {no_skip_word(SN.TREE_SKIP_WORDS)}", "v_files")
ORACLE["f6_pruned_dirs"] = with_(f"SELECT path FROM v_files WHERE {not_pruned(SN.SNIPPET_SOURCES['a'].pruned_dirs)}", "v_files")
ORACLE["f8_byte_bound"] = with_("SELECT path, length FROM v_files WHERE length > 50 AND length < 50000", "v_files")
ORACLE["f9_char_bound"] = with_("SELECT path FROM v_files WHERE length(content) >= 50 AND length(content) <= 50000", "v_files")
ORACLE["f11_issues_not_prs"] = with_("SELECT item_id FROM v_thread_items WHERE pull_request IS NULL", "v_thread_items")

# --- joins --------------------------------------------------------------------------
_registry = "VALUES " + ", ".join(f"('g{i % 5}', 'src{i}')" for i in range(25))
ORACLE["j1_dataset_inventory"] = with_(
    f"SELECT r.\"group\", r.name, c.rows, CASE WHEN c.rows IS NULL THEN 'MISSING' ELSE 'present' END AS status "
    f"FROM ({_registry}) r(\"group\", name) LEFT JOIN (SELECT dataset AS name, count(*) AS rows FROM v_raw GROUP BY 1) c "
    f"USING (name)", "v_raw")
ORACLE["j2_l5_thread_comments"] = with_(
    "SELECT c.parent_key AS item_id, c.ord, c.body FROM (SELECT * FROM v_thread_comments QUALIFY row_number() OVER "
    "(PARTITION BY parent_key ORDER BY ord) <= 5) c JOIN v_thread_items i ON i.item_id = c.parent_key",
    "v_thread_items", "v_thread_comments")

PROBLEMS = per_problem(GENS_CODE)
ORACLE["j3_a7_base_vs_tuned"] = with_(f"""
SELECT b.benchmark, b.passed AS base_passed, f.passed AS ft_passed, b.total,
  round(b.passed / b.total * 100, 6) AS base_rate, round(f.passed / b.total * 100, 6) AS ft_rate,
  round((f.passed - b.passed) / b.total * 100, 6) AS improvement
FROM (SELECT benchmark, CAST(count_if(passed) AS BIGINT) AS passed, count(*) AS total FROM pr WHERE model = 'base' GROUP BY 1) b
JOIN (SELECT benchmark, CAST(count_if(passed) AS BIGINT) AS passed FROM pr WHERE model = 'fine_tuned' GROUP BY 1) f
USING (benchmark)""", "v_generations", extra={"pr": PROBLEMS})

ORACLE["j4_generation_tests"] = with_(
    f"SELECT g.task_id, g.gen, CASE WHEN {truthy('g.code')} THEN g.code || {NL} || t.test END AS full_code "
    f"FROM ({GENS_CODE}) g JOIN v_tests t ON t.task_id = g.task_id", "v_generations", "v_tests")

# --- aggregations ----------------------------------------------------------------------
ORACLE["a1_rows_per_dataset"] = with_("SELECT dataset, count(*) AS rows FROM v_raw GROUP BY 1", "v_raw")
_pfx = head(s("instruction"), 30)
ORACLE["a2_prefix_breakdown"] = with_(
    f"SELECT {_pfx} AS prefix, count(*) AS n FROM v_samples WHERE {_pfx} IN "
    f"(SELECT {_pfx} FROM (SELECT * FROM v_samples ORDER BY seq LIMIT 1000)) GROUP BY 1", "v_samples")
ORACLE["a3_l7_per_problem"] = with_(PROBLEMS, "v_generations")
ORACLE["a4_solved_fraction"] = with_(
    "SELECT benchmark, model, round(coalesce(avg(CAST(passed AS DOUBLE)), 0.0), 6) AS solved_fraction, "
    "CAST(count_if(passed) AS BIGINT) AS passed, count(*) AS total FROM pr GROUP BY 1, 2",
    "v_generations", extra={"pr": PROBLEMS})
ORACLE["a4b_unbiased_pass_at_k"] = with_(
    "SELECT benchmark, model, round(avg(CASE WHEN total - num_passed < 10 THEN 1.0 WHEN num_passed = 0 THEN 0.0 ELSE "
    "1.0 - list_reduce(list_transform(range(total - num_passed + 1, total + 1), lambda i: 1.0 - 10.0 / i), "
    "lambda a, b: a * b) END), 6) AS pass_at_10 FROM pr GROUP BY 1, 2", "v_generations", extra={"pr": PROBLEMS})
ORACLE["a5_custom_pass_rate"] = with_(
    "SELECT model, round(100 * avg(CAST(passed AS DOUBLE)), 6) AS pass_rate FROM v_generations "
    "WHERE benchmark = 'custom' GROUP BY 1", "v_generations")
ORACLE["a6_summary_table"] = with_(
    "SELECT results_key, passed, total, round(passed / total * 100, 6) AS rate FROM (SELECT CASE WHEN model = 'fine_tuned' "
    "THEN benchmark || '_fine_tuned' ELSE benchmark END AS results_key, CAST(count_if(passed) AS BIGINT) AS passed, "
    "count(*) AS total FROM pr GROUP BY 1)", "v_generations", extra={"pr": PROBLEMS})
ORACLE["a8_tool_sample_count"] = with_(
    f"SELECT count(*) AS transformed, CAST(count_if({contains_any(s('instruction'), R.TOOL_KEYWORDS)}) AS BIGINT) AS with_tools "
    f"FROM v_samples WHERE {keep_output()}", "v_samples")

U1 = (f"SELECT 0 AS dataset_ord, * FROM ({ROUTED_RAW}) UNION ALL SELECT 1 AS dataset_ord, * FROM ({ROUTED_SAMPLES})")
A9 = (
    "SELECT 'loaded:' || CAST(dataset_ord AS VARCHAR) AS stage, count(*) AS rows FROM u GROUP BY 1 "
    "UNION ALL SELECT 'loaded', count(*) FROM u "
    f"UNION ALL SELECT 'after_filter', count(*) FROM u WHERE {truthy('instruction')} OR {truthy('output')} "
    f"UNION ALL SELECT 'after_dedup', count(*) FROM ({keep_first(keep_nonempty('SELECT * FROM u'), wide_key(), 'dataset_ord, seq')})")
ORACLE["a9_stage_counts"] = with_(A9, "v_raw", "v_samples", extra={"u": U1})
ORACLE["w1b_merge_counts"] = with_(
    "SELECT stage, rows FROM c UNION ALL SELECT unnest(['written', 'retried']), rows FROM c WHERE stage = 'after_dedup'",
    "v_raw", "v_samples", extra={"u": U1, "c": A9})
ORACLE["a10_loss_perplexity"] = with_(
    "SELECT round(avg(nll), 6) AS eval_loss, count(*) AS tokens, round(exp(avg(nll)), 6) AS eval_perplexity "
    "FROM v_token_loss WHERE label <> -100", "v_token_loss")
ORACLE["a11_steps_per_epoch"] = with_(
    "SELECT train_rows, CAST(floor(train_rows / 16) AS BIGINT) AS steps_per_epoch FROM "
    f"(SELECT count(*) AS train_rows FROM v_samples WHERE NOT ({split_bucket('seq')} < 0.05))", "v_samples")

# --- distinct, union, limits, order --------------------------------------------------------
ORACLE["d1_dedup_wide"] = with_(keep_first(ROUTED_RAW, wide_key(), "seq"), "v_raw")
ORACLE["d2_dedup_narrow"] = with_(keep_first(ROUTED_RAW, narrow_key(), "seq"), "v_raw")
ORACLE["u1_union_ordered"] = with_(f"SELECT dataset_ord, seq, instruction FROM ({U1})", "v_raw", "v_samples")
W1 = keep_first(keep_nonempty(U1), wide_key(), "dataset_ord, seq")
ORACLE["l1_head_after_dedup"] = with_(f"SELECT * FROM ({W1}) ORDER BY dataset_ord, seq LIMIT 500", "v_raw", "v_samples")
ORACLE["l2_scan_cap"] = with_(_fne("(SELECT * FROM v_raw ORDER BY seq LIMIT 300)", *P17_COLS), "v_raw")
ORACLE["l3_keep_cap"] = with_(f"SELECT * FROM ({P16}) ORDER BY seq LIMIT 300", "v_raw")
ORACLE["l4_files_per_repo"] = with_(
    "SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY path) AS INTEGER) AS rank_in_group FROM v_files "
    "QUALIFY rank_in_group <= 10", "v_files")
ORACLE["l6_item_caps"] = thread_samples(50)
ORACLE["l8_benchmark_head"] = with_("SELECT task_id, test FROM v_tests ORDER BY task_id LIMIT 164", "v_tests")
ORACLE["o1_seeded_shuffle"] = with_(
    "SELECT seq, shuffle_key, row_number() OVER (ORDER BY shuffle_key, seq) AS place "
    "FROM (SELECT seq, md5('42:' || CAST(seq AS VARCHAR)) AS shuffle_key FROM v_samples)", "v_samples")
ORACLE["o2_train_eval_split"] = with_(
    f"SELECT seq, CASE WHEN {split_bucket('seq')} < 0.05 THEN 'eval' ELSE 'train' END AS split FROM v_samples", "v_samples")

# --- scalar functions -----------------------------------------------------------------------


def _scalar(name: str, expr: str) -> str:
    return with_(f"SELECT seq, {expr} AS {name} FROM v_samples", "v_samples")


ORACLE["c1_classify_problem"] = _scalar("problem_class", classify("instruction"))
ORACLE["c2_determine_action"] = _scalar("action", cascade("instruction", R.ACTIONS, R.ACTION_DEFAULT))
ORACLE["c3_generate_strategy"] = _scalar("strategy", cascade("instruction", R.STRATEGIES, R.STRATEGY_DEFAULT))
ORACLE["c4_generate_consideration"] = _scalar("consideration", cascade("instruction", R.CONSIDERATIONS, R.CONSIDERATION_DEFAULT))
ORACLE["c5_should_use_tools"] = _scalar("use_tools", contains_any(s("instruction"), R.TOOL_KEYWORDS))
ORACLE["c6_tool_call"] = _scalar("tool_call", tool_call_sql("instruction", "input", "output"))
ORACLE["c7_extract_file_path"] = _scalar("file_path", file_path_sql("input"))
ORACLE["c8_extract_pattern"] = _scalar("pattern", pattern_sql("instruction"))
ORACLE["c9_extract_github_url"] = _scalar("github_url", github_sql("input"))
ORACLE["c10_summarize_problem"] = _scalar("problem", summarize("input", 100, R.PROBLEM_SUMMARY_EMPTY))
ORACLE["c11_summarize_input"] = _scalar("input_summary", summarize("input", 80, R.INPUT_SUMMARY_EMPTY))
ORACLE["c12_reasoning_steps"] = _scalar("steps", steps("instruction"))
ORACLE["c13_reasoning_output"] = _scalar("reasoning", reasoning_output("instruction", "output"))
ORACLE["c14_chain_of_thought"] = _scalar("cot", chain_of_thought("output", "instruction", "input"))
ORACLE["c15_transform_v1"] = with_(transform_v1("v_samples"), "v_samples")
ORACLE["c16_transform_v2"] = with_(transform_v2("v_samples"), "v_samples")
ORACLE["c17_transform_with_tools"] = with_(transform_tools("v_samples"), "v_samples")

ORACLE["c19_prompt_render"] = with_(
    f"SELECT seq, style, CASE WHEN style = 'chat' THEN {render('chat')} WHEN style = 'cot' THEN {render('cot')} "
    f"ELSE {render('inst')} END AS prompt FROM (SELECT *, {pick(['inst', 'chat', 'cot', 'other'], 'seq % 4')} AS style "
    f"FROM v_samples)", "v_samples")

_eval_prompt = fill_template(SC.DEFAULT_PROMPT, instruction="instruction", input="input")
_req_i = f"coalesce(CASE WHEN seq % 7 = 0 THEN {NULLS} ELSE instruction END, {lit(PR.SERVICE_DEFAULT_INSTRUCTION)})"
ORACLE["c20_chat_request"] = with_(
    f"SELECT seq, {lit(PR.SERVICE_SYSTEM_PROMPT)} || {fill_template('[INST] {instruction}' + chr(10) + '{input} [/INST]' + chr(10), instruction=_req_i, input='input')} "
    f"AS request_prompt, {_eval_prompt} AS eval_prompt FROM v_samples", "v_samples")
ORACLE["c21_request_compose"] = _scalar("request_instruction", f"{pick(A.PHRASES, 'seq % 16')} || ' ' || {s('input')}")
ORACLE["c22_extract_code"] = with_(
    "SELECT gen, code_python, code_kotlin FROM (" +
    code_expr_relation(code_expr_relation("SELECT * FROM v_generations", "text", "python", "code_python"),
                       "text", "kotlin", "code_kotlin") + ")", "v_generations")
ORACLE["c23_prompt_echo_removal"] = _scalar(
    "generated_text", f"substr({_eval_prompt} || {s('output')}, length({_eval_prompt}) + 1)")
ORACLE["c24_parse_repo_url"] = with_(
    "SELECT url_id, string_split(rtrim(url, '/'), '/')[-2] AS owner, "
    "replace(string_split(rtrim(url, '/'), '/')[-1], '.git', '') AS repo FROM v_urls", "v_urls")
_t = f"rtrim({strip(s('url'))}, '/')"
_path = f"CASE WHEN starts_with({_t}, 'http://') OR starts_with({_t}, 'https://') THEN regexp_extract({_t}, {lit(PR.URL_PATH_RE)}, 1) ELSE {_t} END"
ORACLE["c25_resolve_repo"] = with_(
    "SELECT url_id, CASE WHEN length(t) = 0 THEN '' WHEN len(parts) = 1 THEN parts[1] || '/my-model' "
    "WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] ELSE '' END AS repo_id FROM "
    f"(SELECT url_id, {_t} AS t, list_filter(string_split({_path}, '/'), lambda p: p <> '') AS parts FROM v_urls)", "v_urls")
_fl = fixed_length("tokens", 2048)
ORACLE["c26_fixed_length_rows"] = with_(
    f"SELECT id, {_fl['input_ids']} AS input_ids, {_fl['attention_mask']} AS attention_mask, {_fl['labels']} AS labels "
    f"FROM v_token_ids", "v_token_ids")
_o60 = s("output")
ORACLE["c27_identifier_rewrite"] = _scalar(
    "rewritten", f"CASE WHEN contains({_o60}, 'n') THEN replace(replace({_o60}, 's', 'str'), 'n', 'num') ELSE {_o60} END")

# --- generators ------------------------------------------------------------------------


def _arr(vals) -> str:
    return "[" + ", ".join(lit(v) for v in vals) + "]"


def _g1() -> str:
    cat = bucket("event_id", "category", str(len(G.CATEGORIES)))
    tasks = "[" + ", ".join(_arr(ts) for _, _, ts in G.CATEGORIES) + "]"
    ct = f"{tasks}[{cat} + 1]"
    task = f"{ct}[{bucket('event_id', 'task', f'len({ct})')} + 1]"
    lang = f"{_arr([c for c, _, _ in G.CATEGORIES])}[{cat} + 1]"
    tpl = f"{_arr([t for _, t, _ in G.CATEGORIES])}[{cat} + 1]"
    body = f"{_arr(G.PYTHON_BODIES)}[{bucket('event_id', 'body', str(len(G.PYTHON_BODIES)))} + 1]"
    inp, out = [], []
    for ln, (itpl, otext) in G.LANGUAGE_IO.items():
        a, rest = itpl.split("{task}")
        if "{body}" in rest:
            b, c = rest.split("{body}")
            val = f"{lit(a)} || task || {lit(b)} || body || {lit(c)}"
        else:
            val = f"{lit(a)} || task || {lit(rest)}"
        inp.append(f"WHEN lang = {lit(ln)} THEN {val}")
        out.append(f"WHEN lang = {lit(ln)} THEN {lit(otext)}")
    return (f"SELECT id, lang AS category, replace(tpl, '{{task}}', task) AS instruction, "
            f"substr(CASE {' '.join(inp)} END, 1, 500) AS input, substr(CASE {' '.join(out)} END, 1, 500) AS output "
            f"FROM (SELECT event_id AS id, {task} AS task, {lang} AS lang, {tpl} AS tpl, {body} AS body FROM events)")


ORACLE["g1_template_grid"] = _g1()
_k = bucket("event_id", "example", str(len(G.EXAMPLE_BANK)))
ORACLE["g2_example_bank"] = (
    f"SELECT event_id AS id, {_arr([e[0] for e in G.EXAMPLE_BANK])}[{_k} + 1] AS instruction, "
    f"{_arr([e[1] for e in G.EXAMPLE_BANK])}[{_k} + 1] AS input, {_arr([e[2] for e in G.EXAMPLE_BANK])}[{_k} + 1] AS output "
    f"FROM events")

# --- composed jobs ---------------------------------------------------------------------
ORACLE["w1_merge"] = with_(W1, "v_raw", "v_samples")
ORACLE["w2_process_and_merge"] = with_(keep_first(ROUTE_SQL, narrow_key(), "dataset_ord, seq, sample_no"), *NAMED)
_w3_files = (f"SELECT path, content FROM v_files WHERE {has_ext(SN.TREE_EXTS)} AND {no_skip_word(SN.TREE_SKIP_WORDS)}")
ORACLE["w3_tree_samples"] = with_(fanout(tree_chunks(_w3_files)), "v_files")
ORACLE["w4_thread_samples"] = thread_samples(None)
_SAMPLE = "SELECT instruction, input, output FROM"


def placed(sql: str, order: str) -> str:
    """The samples of a query with their places in ``order``."""
    return f"SELECT row_number() OVER (ORDER BY {order}) AS place, instruction, input, output FROM ({sql})"


ORACLE["w5_reasoning_v1"] = with_(placed(transform_v1('v_samples'), "seq"), "v_samples")
ORACLE["w6_reasoning_v2"] = with_(placed(transform_tools('v_samples'), "seq"), "v_samples")
ORACLE["w6b_reasoning_v2_head"] = with_(
    placed(transform_v2('(SELECT * FROM v_samples ORDER BY seq LIMIT 100)'), "seq"), "v_samples")
_flw = fixed_length("t.tokens", 2048)
ORACLE["w7_training_rows"] = with_(
    f"SELECT s.seq, {render('inst')} AS prompt, {_flw['input_ids']} AS input_ids, {_flw['attention_mask']} AS attention_mask, "
    f"{_flw['labels']} AS labels, md5('42:' || CAST(s.seq AS VARCHAR)) AS shuffle_key, "
    f"CASE WHEN {split_bucket('s.seq')} < 0.05 THEN 'eval' ELSE 'train' END AS split "
    f"FROM v_samples s JOIN v_token_ids t ON t.id = s.seq", "v_samples", "v_token_ids")
_w8_gens = f"SELECT g.* FROM ({GENS_CODE}) g JOIN v_tests t ON t.task_id = g.task_id"
ORACLE["w8_benchmark_scoring"] = with_(
    f"SELECT p.*, substr(t.prompt, 1, 50) AS prompt FROM ({per_problem(_w8_gens)}) p JOIN v_tests t ON t.task_id = p.task_id",
    "v_generations", "v_tests")
ORACLE["w9_problem_conversion"] = with_(placed(P12, "item_id % 2, item_id"), "v_problems")
ORACLE["w10_repo_snippets"] = with_(
    " UNION ALL ".join(f"SELECT *, '{k}' AS variant FROM ({snippets('v_files', sc)})" for k, sc in SN.SNIPPET_SOURCES.items()),
    "v_files")

# --- remaining inventory rows ---------------------------------------------------------
ORACLE["f10_snippet_and_chunk_length"] = with_(
    f"SELECT path, length(snippet) > 100 AS snippet_ok, length({strip('content')}) > 20 AS chunk_ok "
    f"FROM (SELECT path, content, {head_lines('content', 40)} AS snippet FROM v_files)", "v_files")
ORACLE["f12_discussion_body_length"] = with_(
    f"SELECT item_id FROM v_thread_items WHERE length({s('body')}) > 50", "v_thread_items")
ORACLE["j5_chunk_task_fanout"] = with_(
    fanout(f"SELECT path, chunk_no, chunk FROM ({chunks('SELECT path, content FROM v_files', 40)}) "
           f"WHERE length({strip('chunk')}) > 20"), "v_files")
_RAW_COLS = "seq, instruction, input, output, prompt, completion, text, code, question, solutions"
ORACLE["s1_s4_jsonl_strict_roundtrip"] = with_(
    f"SELECT {_RAW_COLS} FROM v_raw WHERE {truthy('instruction')} OR {truthy('prompt')}", "v_raw")
ORACLE["s2_jsonl_lenient_scan"] = with_(
    "SELECT seq, instruction, CASE WHEN seq % 19 = 16 THEN 'again' ELSE prompt END AS prompt FROM v_raw "
    "WHERE seq % 23 <> 7 AND seq % 17 <> 5 AND seq % 19 NOT IN (3, 5, 6, 8, 11, 14, 17)", "v_raw")
ORACLE["s3_rejected_lines"] = with_(
    "SELECT seq, true AS in_order FROM v_raw WHERE seq % 23 <> 7 AND (seq % 17 = 5 OR seq % 19 IN (3, 5, 6, 8, 11, 14, 17))", "v_raw")
_TREE = ("SELECT 'source=' || source AS repo, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, "
         "CAST(sum(length(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(65533), '')) + 1) AS BIGINT) AS chars "
         "FROM documents GROUP BY 1")
ORACLE["s6_s7_tree_scan"] = (
    f"SELECT 'whole' AS scan, * FROM ({_TREE}) UNION ALL "
    f"SELECT 'pruned', * FROM ({_TREE}) WHERE repo NOT IN ('source=src1', 'source=src4', 'source=src9')")
ORACLE["s9_s10_parquet_grid"] = with_(
    f"SELECT seq, split, lang, 'Explain this ' || lang || ' code:' AS instruction, {head(s('func_code_string'), 2000)} AS input, "
    f"CASE WHEN {truthy('func_documentation_string')} THEN {head('func_documentation_string', 500)} "
    f"ELSE 'Function from ' || coalesce(repository_name, 'codebase') END AS output FROM v_code_doc "
    f"WHERE lang IN ('python', 'go', 'ruby') AND split IN ('train', 'test') "
    f"AND {truthy(s('func_code_string'))} AND length({s('func_code_string')}) > 50", "v_code_doc")
ORACLE["s5_append_sink"] = with_(placed("SELECT * FROM v_samples", "seq % 2, seq"), "v_samples")
ORACLE["s4_ordered_sink"] = with_(placed("SELECT * FROM v_samples", "seq"), "v_samples")
ORACLE["s11_concat_files"] = with_(
    placed(f"SELECT 0 AS o, seq, instruction, input, output FROM v_samples UNION ALL "
           f"SELECT 1, seq, instruction, input, output FROM ({keep_nonempty(ROUTED_RAW)})", "o, seq"), "v_raw", "v_samples")
_files = "VALUES " + ", ".join(
    f"({lit(g)}, {lit(n)}, {k})" for k, (g, n) in enumerate((g, n) for g, ns in DATASET_GROUPS.items() for n in ns))
ORACLE["s12_s15_file_inventory"] = with_(
    f"SELECT r.\"group\", r.name, c.lines, CASE WHEN c.lines IS NULL THEN 'MISSING' ELSE 'present' END AS status, r.reg_ord "
    f"FROM ({_files}) r(\"group\", name, reg_ord) LEFT JOIN (SELECT ['apps_train', 'github_code', 'mbpp_extra'][seq % 3 + 1] AS name, "
    f"count(*) AS lines FROM v_samples GROUP BY 1) c USING (name)", "v_samples")
ORACLE["s13_merge_files"] = with_(placed(W1, "dataset_ord, seq"), "v_raw", "v_samples")
ORACLE["w2b_process_file_order"] = with_(
    placed(keep_first(ROUTE_SQL, narrow_key(), "dataset_ord, seq, sample_no"), "dataset_ord, seq, sample_no"), *NAMED)
ORACLE["s14_results_sink"] = ORACLE["w8_benchmark_scoring"]
ORACLE["o2b_exact_split"] = with_(
    "SELECT seq, CASE WHEN row_number() OVER (ORDER BY h, seq) <= ceil(0.05 * count(*) OVER ()) THEN 'eval' "
    "ELSE 'train' END AS split FROM (SELECT seq, CAST(('0x' || substr(md5('split42:' || CAST(seq AS VARCHAR)), 1, 8)) "
    "AS BIGINT) AS h FROM v_samples)", "v_samples")
