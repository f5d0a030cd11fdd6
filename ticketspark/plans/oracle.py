"""Reference SQL (DuckDB dialect) for each registered query.

Written independently of the Spark plans, as the plain textbook form of each
operator (windows over whole classes, cross joins with the class table, ...): it is
a correctness oracle for small scale factors, not an execution strategy.
"""

from __future__ import annotations

from ticketspark.sources.fixtures import EVENT_TYPES

SEED = 42
TEST_FRACTION = 0.15
EVAL_PER_CLASS = 10
SUBSET_CAP = 370
MAX_TOKENS = 192
ROUTE_THRESHOLD = 0.9

# Same markup and wording as ticketspark.functions.prompts.
SYSTEM_TEXT = ("Pick the label that fits the customer's message best and answer with that label alone.\n"
               "Labels: ")
TURN_OPEN, ROLE_END, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TOKEN_PUNCT = ".,;:!?\"'()[]{}"
ERROR_PREFIX = "A request is a JSON object with a message; this one is wrong: "


def lit(s: str) -> str:
    """SQL string literal; newlines via chr(10) so the text survives any client."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def md5key(id_expr: str, seed: int = SEED) -> str:
    return f"md5('{seed}|' || CAST({id_expr} AS VARCHAR))"


def bucket(tag: str, id_expr: str) -> str:
    return f"(instr('0123456789abcdef', substr(md5('{tag}|' || CAST({id_expr} AS VARCHAR)), 1, 1)) - 1)"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def toks(x: str) -> str:
    """non-empty whitespace tokens of lower(x)"""
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


def raw_toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


TICKETS = ("tickets AS (SELECT doc_id AS ticket_id, text AS instruction, lang AS intent, "
           "source AS category, n_chars FROM documents)")
DEDUP = ("dedup AS (SELECT ticket_id, instruction, intent, category, n_chars FROM ("
         "SELECT *, row_number() OVER (PARTITION BY instruction ORDER BY ticket_id) AS rn "
         "FROM tickets) WHERE rn = 1)")


def split_ctes(name: str, src: str) -> str:
    """CTE ``name``: src columns + split, by largest-remainder quotas and md5 order."""
    return f""",
{name}_sz AS (SELECT intent AS g, count(*) AS n_rows FROM {src} GROUP BY 1),
{name}_a1 AS (SELECT g, n_rows, sum(n_rows) OVER () AS big_n FROM {name}_sz),
{name}_a2 AS (SELECT *, ceil(CAST(big_n AS DOUBLE) * CAST({TEST_FRACTION} AS DOUBLE)) AS big_t FROM {name}_a1),
{name}_a3 AS (SELECT *, CAST(n_rows AS DOUBLE) * big_t / big_n AS share FROM {name}_a2),
{name}_a4 AS (SELECT *, floor(share) AS fl FROM {name}_a3),
{name}_a5 AS (SELECT *, big_t - sum(fl) OVER () AS lft,
              row_number() OVER (ORDER BY share - fl DESC, g ASC) AS rk FROM {name}_a4),
{name}_alloc AS (SELECT g AS intent, n_rows,
              CAST(fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM {name}_a5),
{name} AS (SELECT k.ticket_id, k.instruction, k.intent, k.category, k.n_chars,
              CASE WHEN k.rn <= a.n_test THEN 'test' ELSE 'train' END AS split
           FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY {md5key('ticket_id')}, ticket_id) AS rn
                 FROM {src}) k JOIN {name}_alloc a ON k.intent = a.intent)"""


def first_n_cte(name: str, src: str, n: int) -> str:
    return f""",
{name} AS (SELECT * EXCLUDE (rn_s) FROM (SELECT *, row_number() OVER (
    PARTITION BY intent ORDER BY {md5key('ticket_id')}, ticket_id) AS rn_s FROM {src}) WHERE rn_s <= {n})"""


def nb_ctes(p: str, train: str, test: str, extra: str = "") -> str:
    """``{p}_pred``: (ticket_id, {extra}, predicted_intent, confidence) for ``test``."""
    extra_sel = f", {extra}" if extra else ""
    return f""",
{p}_cnt AS (SELECT class, token, count(*) AS cnt FROM (
    SELECT intent AS class, unnest({toks('instruction')}) AS token FROM {train}) GROUP BY 1, 2),
{p}_v AS (SELECT count(DISTINCT token) AS v FROM {p}_cnt),
{p}_docs AS (SELECT intent AS class, count(*) AS n_docs FROM {train} GROUP BY 1),
{p}_ntok AS (SELECT class, sum(cnt) AS n_tokens FROM {p}_cnt GROUP BY 1),
{p}_cls AS (SELECT d.class, ln(d.n_docs) - ln(sum(d.n_docs) OVER ()) AS prior,
    ln(1.0) - ln(coalesce(t.n_tokens, 0) + 1.0 * (SELECT v FROM {p}_v)) AS dflt
    FROM {p}_docs d LEFT JOIN {p}_ntok t USING (class)),
{p}_w AS (SELECT token, class, ln(cnt + 1.0) - ln(1.0) AS w FROM {p}_cnt),
{p}_vocab AS (SELECT DISTINCT token FROM {p}_cnt),
{p}_occ AS (SELECT ticket_id, unnest({toks('instruction')}) AS token FROM {test}),
{p}_l AS (SELECT o.ticket_id, count(*) AS l FROM {p}_occ o JOIN {p}_vocab USING (token) GROUP BY 1),
{p}_s AS (SELECT o.ticket_id, w.class, sum(w.w) AS s FROM {p}_occ o JOIN {p}_w w USING (token) GROUP BY 1, 2),
{p}_sc AS (SELECT t.ticket_id{extra_sel.replace(', ', ', t.') if extra else ''}, c.class,
    c.prior + coalesce(l.l, 0) * c.dflt + coalesce(s.s, 0) AS score
    FROM {test} t CROSS JOIN {p}_cls c
    LEFT JOIN {p}_l l ON l.ticket_id = t.ticket_id
    LEFT JOIN {p}_s s ON s.ticket_id = t.ticket_id AND s.class = c.class),
{p}_b AS (SELECT *, max(score) OVER (PARTITION BY ticket_id) AS best,
    row_number() OVER (PARTITION BY ticket_id ORDER BY round(score, 6) DESC, class) AS rn FROM {p}_sc),
{p}_conf AS (SELECT ticket_id, 1.0 / sum(exp(score - best)) AS confidence FROM {p}_b GROUP BY 1),
{p}_pred AS (SELECT b.ticket_id{extra_sel.replace(', ', ', b.') if extra else ''},
    b.class AS predicted_intent, c.confidence
    FROM {p}_b b JOIN {p}_conf c USING (ticket_id) WHERE b.rn = 1)"""


def kw_ctes(p: str, label_src: str, label_col: str, src: str, id_col: str = "ticket_id",
            text_col: str = "instruction") -> str:
    """``{p}_best``: (id, label) winner per id with hits > 0."""
    punct = TOKEN_PUNCT.replace("'", "''")
    return f""",
{p}_rules AS (SELECT DISTINCT label, kw AS keyword FROM (
    SELECT label, unnest(string_split(lower(label), '_')) AS kw FROM (
        SELECT DISTINCT {label_col} AS label FROM {label_src} WHERE {label_col} IS NOT NULL)) WHERE kw <> ''),
{p}_tok AS (SELECT {id_col} AS kid, trim(tok, '{punct}') AS keyword FROM (
    SELECT {id_col}, unnest({toks(text_col)}) AS tok FROM {src})),
{p}_hits AS (SELECT t.kid, r.label, count(*) AS hits FROM {p}_tok t
    JOIN {p}_rules r ON t.keyword = r.keyword WHERE t.keyword <> '' GROUP BY 1, 2),
{p}_best AS (SELECT kid, label FROM (SELECT *, row_number() OVER (
    PARTITION BY kid ORDER BY hits DESC, label) AS rn FROM {p}_hits) WHERE rn = 1)"""


def scored_cte() -> str:
    ba, bb = bucket("A", "event_id"), bucket("B", "event_id")
    return f"""scored AS (
SELECT event_id AS ticket_id, event_type AS intent, 'A' AS arm,
  CASE {ba} WHEN 0 THEN 'none' WHEN 1 THEN 'view' WHEN 2 THEN 'sort_list'
    WHEN 3 THEN '  "' || upper(event_type) || '." ' WHEN 4 THEN 'Intent: ' || event_type
    WHEN 5 THEN 'click or view' WHEN 6 THEN '' ELSE event_type END AS raw_output
FROM events
UNION ALL
SELECT event_id, event_type, 'B',
  CASE {bb} WHEN 0 THEN 'view' WHEN 1 THEN '"' || event_type || '"' ELSE event_type END
FROM events)"""


def decoded_cte() -> str:
    return scored_cte() + """,
labs AS (SELECT list_sort(list_distinct(list(intent))) AS labels FROM scored),
cleaned AS (SELECT scored.*, labels, trim(lower(""" + strip_ws("raw_output") + """), '."''') AS cl
            FROM scored, labs),
decoded AS (SELECT ticket_id, intent, arm, raw_output,
  coalesce(list_filter(labels, lambda l: lower(l) = cl)[1],
           list_filter(labels, lambda l: contains(cl, lower(l)))[1], 'UNPARSEABLE') AS predicted_intent
  FROM cleaned)"""


def outcomes_cte(src: str) -> str:
    """oc(arm, actual, predicted, n) + per-class report cr."""
    return f""",
oc AS (SELECT arm, intent AS actual, predicted_intent AS predicted, count(*) AS n FROM {src} GROUP BY 1, 2, 3),
lab AS (SELECT DISTINCT arm, actual AS label FROM oc),
sup AS (SELECT arm, actual AS label, sum(n) AS support FROM oc GROUP BY 1, 2),
tp AS (SELECT arm, actual AS label, sum(n) AS tp FROM oc WHERE actual = predicted GROUP BY 1, 2),
prd AS (SELECT arm, predicted AS label, sum(n) AS npred FROM oc GROUP BY 1, 2),
cr0 AS (SELECT l.arm, l.label, coalesce(s.support, 0) AS support, coalesce(t.tp, 0) AS tp,
        coalesce(p.npred, 0) AS npred
        FROM lab l LEFT JOIN sup s USING (arm, label) LEFT JOIN tp t USING (arm, label)
        LEFT JOIN prd p USING (arm, label)),
cr AS (SELECT arm, label,
  CASE WHEN npred <> 0 THEN CAST(tp AS DOUBLE) / npred ELSE 0.0 END AS precision,
  CASE WHEN support <> 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
  CASE WHEN support + npred <> 0 THEN CAST(2 * tp AS DOUBLE) / (support + npred) ELSE 0.0 END AS f1,
  CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(npred AS BIGINT) AS n_predicted
  FROM cr0)"""


def requests_cte() -> str:
    b = bucket("R", "event_id")
    return f"""rq AS (SELECT event_id AS request_id, event_type AS intent,
  CASE {b} WHEN 0 THEN '{{bad' WHEN 1 THEN '[1]' WHEN 2 THEN '{{"msg":"' || event_type || '"}}'
    WHEN 3 THEN '{{"message":null}}' WHEN 4 THEN '{{"message":"  "}}' WHEN 5 THEN '{{"message":5,"x":1}}'
    WHEN 6 THEN '{{"message":"' || event_type || '"}} and more' WHEN 7 THEN '{{''message'':''' || event_type || '''}}'
    WHEN 8 THEN '{{"message":"first","message":"' || event_type || '"}}' WHEN 9 THEN '{{"message":"' || event_type || '"}}]'
    ELSE '{{"message":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}}' END AS body
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE {b} = 10)),
val AS (SELECT request_id, body,
  CASE WHEN NOT json_valid(body) THEN 'malformed'
       WHEN json_type(body) <> 'OBJECT' THEN 'not_object'
       WHEN NOT list_contains(json_keys(body), 'message') THEN 'missing_message' END AS error_kind
  FROM rq),
-- of equal keys the last one's value counts
last_value AS (SELECT b.body, arg_max(json_extract_string(e.value, '$'), e.id) AS message
  FROM (SELECT DISTINCT body FROM val WHERE error_kind IS NULL) b, json_each(b.body) e
  WHERE e.key = 'message' GROUP BY b.body),
validated AS (SELECT request_id, error_kind IS NULL AS accepted, error_kind, l.message
  FROM val LEFT JOIN last_value l ON val.error_kind IS NULL AND l.body = val.body)"""


def chat_turn(role: str, content: str) -> str:
    return f"{lit(TURN_OPEN)} || {role} || {lit(ROLE_END)} || {content} || {lit(TURN_CLOSE)}"


def class_text(label_line: str, message: str, answer: str | None) -> str:
    sys_t = chat_turn("'system'", f"{lit(SYSTEM_TEXT)} || {label_line}")
    usr_t = chat_turn("'user'", message)
    end = chat_turn("'assistant'", answer) if answer else f"{lit(TURN_OPEN)} || 'assistant' || {lit(ROLE_END)}"
    return f"{sys_t} || {usr_t} || {end}"


SPLIT = f"WITH {TICKETS}, {DEDUP}{split_ctes('sp', 'dedup')}"
TRAIN = ",\ntrain AS (SELECT * EXCLUDE (split) FROM sp WHERE split = 'train')"
TEST = ",\ntest AS (SELECT * EXCLUDE (split) FROM sp WHERE split = 'test')"


def eval_arms_sql() -> str:
    return (SPLIT + TRAIN + TEST + ",\nev AS (SELECT * FROM test)"
            + kw_ctes("kw", "train", "intent", "ev")
            + nb_ctes("nb", "train", "ev", "intent")
            + """,
arms AS (
  SELECT e.ticket_id, e.intent, e.instruction, 'zero_shot' AS arm,
         coalesce(k.label, 'UNPARSEABLE') AS predicted_intent
  FROM ev e LEFT JOIN kw_best k ON k.kid = e.ticket_id
  UNION ALL
  SELECT e.ticket_id, e.intent, e.instruction, 'tuned', n.predicted_intent
  FROM ev e JOIN nb_pred n USING (ticket_id))""")


def _q() -> dict[str, str]:
    q: dict[str, str] = {}
    T = f"WITH {TICKETS}"

    q["load_tickets"] = f"{T} SELECT *, CAST(NULL AS VARCHAR) AS reject_reason FROM tickets"
    q["clean_messages"] = f"""WITH {requests_cte()}
SELECT request_id, {strip_ws('message')} AS message FROM validated
WHERE accepted AND length({strip_ws('message')}) > 0"""
    q["label_vocab"] = f"""{T} SELECT label, row_number() OVER (ORDER BY label) AS label_rank
FROM (SELECT DISTINCT intent AS label FROM tickets WHERE intent IS NOT NULL)"""
    q["label_prompt_line"] = f"""{T} SELECT array_to_string(list_sort(list_distinct(list(intent))), ', ') AS label_line,
count(DISTINCT intent) AS n_labels FROM tickets"""
    q["label_drift"] = f"""WITH {scored_cte()},
d AS (SELECT DISTINCT arm, intent AS label FROM scored),
o AS (SELECT DISTINCT arm, {strip_ws('raw_output')} AS label FROM scored)
SELECT arm, 'declared_only' AS side, label FROM (SELECT * FROM d EXCEPT SELECT * FROM o)
UNION ALL
SELECT arm, 'observed_only', label FROM (SELECT * FROM o EXCEPT SELECT * FROM d)"""

    q["row_count"] = f"""{T} SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
'ticket_id,instruction,intent,category,n_chars' AS columns FROM tickets"""
    q["intent_counts"] = f"""{T} SELECT intent, count(*) AS n,
round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tickets GROUP BY 1"""
    q["intent_cardinality"] = f"{T} SELECT count(DISTINCT intent) AS n_intents FROM tickets"
    q["class_extremes"] = f"""{T}, c AS (SELECT intent, count(*) AS n FROM tickets GROUP BY 1)
SELECT (SELECT intent FROM c ORDER BY n, intent LIMIT 1) AS smallest_intent,
       (SELECT min(n) FROM c) AS smallest_n,
       (SELECT intent FROM c ORDER BY n DESC, intent LIMIT 1) AS largest_intent,
       (SELECT max(n) FROM c) AS largest_n"""
    q["sample_rows"] = f"""{T} SELECT ticket_id, instruction, intent FROM tickets
ORDER BY {md5key('ticket_id')}, ticket_id LIMIT 5"""
    q["class_balance"] = f"""{T}, {DEDUP},
ph AS (SELECT 'raw' AS phase, intent FROM tickets UNION ALL SELECT 'dedup', intent FROM dedup),
c AS (SELECT phase, intent, count(*) AS n FROM ph GROUP BY 1, 2)
SELECT phase, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, min(n) AS min_class,
max(n) AS max_class, round(max(n) / min(n), 6) AS max_min_ratio FROM c GROUP BY 1"""
    q["length_profile"] = f"""{T}, l AS (SELECT len({raw_toks('instruction')}) AS n FROM tickets)
SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens,
round(quantile_cont(n, 0.5), 6) AS p50_tokens, round(quantile_cont(n, 0.95), 6) AS p95_tokens,
CAST(sum(CASE WHEN n > 192 THEN 1 ELSE 0 END) AS BIGINT) AS over_192,
CAST(sum(CASE WHEN n > 512 THEN 1 ELSE 0 END) AS BIGINT) AS over_512 FROM l"""

    q["dedup_tickets"] = f"{T}, {DEDUP} SELECT * FROM dedup"
    q["dedup_report"] = f"""{T} SELECT count(*) AS n_before, count(DISTINCT instruction) AS n_after,
count(*) - count(DISTINCT instruction) AS n_removed FROM tickets"""
    q["duplicate_groups"] = f"""{T}, g AS (SELECT instruction, count(*) AS group_size FROM tickets GROUP BY 1)
SELECT group_size, count(*) AS n_groups, (group_size - 1) * count(*) AS redundant_rows
FROM g WHERE group_size > 1 GROUP BY 1"""
    q["label_conflicts"] = f"""{T}, k AS (SELECT instruction, intent AS label, 'intent' AS key FROM tickets
  UNION ALL SELECT instruction, category, 'category' FROM tickets),
p AS (SELECT key, instruction, label, count(*) AS n FROM k GROUP BY ALL)
SELECT md5(instruction) AS text_md5, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels,
string_agg(label, ',' ORDER BY label) AS labels, key FROM p GROUP BY key, instruction HAVING count(*) > 1"""

    q["split_train"] = f"{SPLIT} SELECT ticket_id, intent FROM sp WHERE split = 'train'"
    q["split_test"] = f"{SPLIT} SELECT ticket_id, intent FROM sp WHERE split = 'test'"
    q["split_allocation"] = f"""{SPLIT} SELECT intent, n_rows, n_test, n_rows - n_test AS n_train FROM sp_alloc"""
    q["sample_strict"] = f"{SPLIT}{TEST}{first_n_cte('s', 'test', EVAL_PER_CLASS)} SELECT ticket_id, intent FROM s"
    q["sample_capped"] = f"{SPLIT}{TRAIN}{first_n_cte('s', 'train', SUBSET_CAP)} SELECT ticket_id, intent FROM s"
    q["split_report"] = f"""{SPLIT} SELECT split, count(*) AS n_rows, count(DISTINCT intent) AS n_intents
FROM sp GROUP BY 1"""
    q["arm_alignment"] = f"""WITH {scored_cte()},
a AS (SELECT DISTINCT ticket_id FROM scored WHERE arm = 'A'),
b AS (SELECT DISTINCT ticket_id FROM scored WHERE arm = 'B')
SELECT count(CASE WHEN a.ticket_id IS NOT NULL AND b.ticket_id IS NOT NULL THEN 1 END) AS n_both,
       count(CASE WHEN b.ticket_id IS NULL THEN 1 END) AS n_left_only,
       count(CASE WHEN a.ticket_id IS NULL THEN 1 END) AS n_right_only
FROM a FULL OUTER JOIN b ON a.ticket_id = b.ticket_id"""
    leak = """,
tt AS (SELECT instruction, count(*) AS n FROM {s} WHERE split = 'test' GROUP BY 1),
tr AS (SELECT DISTINCT instruction FROM {s} WHERE split = 'train')
SELECT CAST(sum(n) AS BIGINT) AS n_test,
       CAST(coalesce(sum(CASE WHEN tr.instruction IS NOT NULL THEN n END), 0) AS BIGINT) AS n_leaked,
       round(CASE WHEN sum(n) > 0 THEN coalesce(sum(CASE WHEN tr.instruction IS NOT NULL THEN n END), 0) / sum(n)
             ELSE 0.0 END, 6) AS leak_rate
FROM tt LEFT JOIN tr USING (instruction)"""
    q["leakage_row_split"] = f"{T}{split_ctes('rs', 'tickets')}" + leak.format(s="rs")
    q["leakage_dedup_split"] = SPLIT + leak.format(s="sp")
    q["accuracy_by_leak"] = (
        f"{T}{split_ctes('rs', 'tickets')}"
        + ",\nrtrain AS (SELECT * EXCLUDE (split) FROM rs WHERE split = 'train')"
        + ",\nrtest AS (SELECT * EXCLUDE (split) FROM rs WHERE split = 'test')"
        + first_n_cte("ev", "rtest", EVAL_PER_CLASS)
        + """,
evl AS (SELECT rt.*, tr.instruction IS NOT NULL AS leaked FROM rtest rt
        LEFT JOIN (SELECT DISTINCT instruction FROM rtrain) tr USING (instruction))"""
        + nb_ctes("nb", "rtrain", "evl", "intent, leaked")
        + """,
both_sets AS (SELECT *, 'all' AS rows_of FROM nb_pred
    UNION ALL SELECT *, 'sample' FROM nb_pred WHERE ticket_id IN (SELECT ticket_id FROM ev))
SELECT leaked, rows_of, count(*) AS n_rows,
       CAST(sum(CASE WHEN predicted_intent = intent THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN predicted_intent = intent THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM both_sets GROUP BY ALL""")
    q["split_roundtrip"] = f"{SPLIT} SELECT ticket_id, intent, split, md5(instruction) AS text_md5 FROM sp"
    q["predictions_csv"] = eval_arms_sql() + """
SELECT arm, ticket_id, intent, predicted_intent, md5(instruction) AS text_md5 FROM arms"""
    q["split_fingerprint"] = f"""{SPLIT} SELECT split, count(*) AS n_rows, CAST(sum(CAST(
('0x' || substr(md5(CAST(ticket_id AS VARCHAR) || '|' || md5(intent) || '|' || md5(instruction)), 1, 15))::BIGINT
AS HUGEINT)) AS VARCHAR) AS fingerprint FROM sp GROUP BY 1"""

    train_line = "(SELECT array_to_string(list_sort(list_distinct(list(intent))), ', ') FROM train)"
    test_line = "(SELECT array_to_string(list_sort(list_distinct(list(intent))), ', ') FROM test)"
    sft = class_text("ll.line", "instruction", "intent")
    q["sft_examples"] = f"""{SPLIT}{TRAIN}, ll AS (SELECT {train_line} AS line),
ex AS (SELECT ticket_id, intent, {sft} AS text FROM train, ll)
SELECT ticket_id, intent, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_chars FROM ex"""
    inf = class_text("ll.line", "instruction", None)
    q["inference_prompts"] = f"""{SPLIT}{TEST}, ll AS (SELECT {test_line} AS line),
p AS (SELECT ticket_id, {inf} AS prompt FROM test, ll)
SELECT ticket_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM p"""
    q["render_chat"] = f"""WITH c AS (SELECT conv_id, count(*) AS n_turns,
  string_agg({chat_turn('role', 'text')}, '' ORDER BY turn) AS chat FROM conversations GROUP BY 1)
SELECT conv_id, n_turns, md5(chat) AS chat_md5, CAST(length(chat) AS BIGINT) AS chat_chars FROM c"""
    q["truncate_examples"] = f"""{SPLIT}{TRAIN}, ll AS (SELECT {train_line} AS line),
ex AS (SELECT ticket_id, {sft} AS text FROM train, ll),
t AS (SELECT ticket_id, {raw_toks('text')} AS tk FROM ex),
c AS (SELECT ticket_id, CAST(len(tk) AS BIGINT) AS n_tokens, len(tk) > {MAX_TOKENS} AS truncated,
      array_to_string(tk[1:{MAX_TOKENS}], ' ') AS text_cut FROM t)
SELECT ticket_id, n_tokens, truncated, md5(text_cut) AS cut_md5,
       CAST(length(text_cut) AS BIGINT) AS cut_chars FROM c"""

    kw_test = SPLIT + TRAIN + TEST + kw_ctes("kw", "train", "intent", "test")
    q["predict_batch"] = kw_test + """
SELECT t.ticket_id, t.intent, coalesce(k.label, 'none') AS raw_output,
       coalesce(k.label, 'UNPARSEABLE') AS predicted_intent
FROM test t LEFT JOIN kw_best k ON k.kid = t.ticket_id"""
    q["predict_keyword"] = kw_test + """
SELECT t.ticket_id, t.intent, coalesce(k.label, 'UNPARSEABLE') AS predicted_intent
FROM test t LEFT JOIN kw_best k ON k.kid = t.ticket_id"""
    q["predict_lr"] = f"""{SPLIT}{TEST} SELECT ticket_id, intent, true AS ok FROM test
UNION ALL SELECT -1, '(all)', true"""
    q["predict_lr_table"] = q["predict_lr"]
    q["predict_nb"] = SPLIT + TRAIN + TEST + nb_ctes("nb", "train", "test", "intent") + """
SELECT ticket_id, intent, predicted_intent, round(confidence, 6) AS confidence FROM nb_pred"""

    dec = f"WITH {decoded_cte()}"
    q["decode_lenient"] = f"{dec} SELECT ticket_id, arm, intent, raw_output, predicted_intent FROM decoded"
    q["decode_strict"] = f"""WITH {scored_cte()},
labs AS (SELECT list_sort(list_distinct(list(intent))) AS labels FROM scored)
SELECT ticket_id, arm, coalesce(list_contains(labels, {strip_ws('raw_output')}), false) AS is_label
FROM scored, labs"""
    q["decode_raw"] = f"WITH {scored_cte()} SELECT ticket_id, arm, {strip_ws('raw_output')} AS output FROM scored"

    H = dec + outcomes_cte("decoded")
    q["accuracy"] = H + """
SELECT arm, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n), 6) AS accuracy
FROM oc GROUP BY 1"""
    q["classification_report"] = H + """
SELECT arm, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM cr"""
    q["macro_avg"] = H + """
SELECT arm, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM cr GROUP BY 1"""
    q["weighted_avg"] = H + """
SELECT arm, round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support
FROM cr GROUP BY 1"""
    q["micro_avg"] = H + """,
m AS (SELECT arm, sum(tp) AS tp, sum(n_predicted) AS inl, sum(support) AS support FROM cr GROUP BY 1),
t AS (SELECT arm, sum(n) AS n_rows FROM oc GROUP BY 1),
pr AS (SELECT m.arm, CASE WHEN inl = n_rows THEN 'accuracy' ELSE 'micro avg' END AS row_kind,
       CASE WHEN inl <> 0 THEN tp / inl ELSE 0.0 END AS p,
       CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS r, support
       FROM m JOIN t USING (arm))
SELECT arm, row_kind, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pr"""
    q["confusion_matrix"] = H + """
SELECT a.arm, a.label AS actual, p.label AS predicted, CAST(coalesce(oc.n, 0) AS BIGINT) AS n
FROM lab a JOIN lab p ON a.arm = p.arm
LEFT JOIN oc ON oc.arm = a.arm AND oc.actual = a.label AND oc.predicted = p.label"""
    q["confusion_cells"] = H + """
SELECT oc.arm, oc.actual, oc.predicted, CAST(n AS BIGINT) AS n FROM oc
JOIN lab p ON p.arm = oc.arm AND p.label = oc.predicted WHERE oc.actual IS NOT NULL"""
    q["confusion_pivot"] = H + """,
cm AS (SELECT a.arm, a.label AS actual, p.label AS predicted, CAST(coalesce(oc.n, 0) AS BIGINT) AS n
       FROM lab a JOIN lab p ON a.arm = p.arm
       LEFT JOIN oc ON oc.arm = a.arm AND oc.actual = a.label AND oc.predicted = p.label)
SELECT arm, actual, """ + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE predicted = '{x}'), 0) AS BIGINT) AS \"{x}\"" for x in EVENT_TYPES) + """
FROM cm GROUP BY arm, actual"""
    q["unparseable_rate"] = H + """
SELECT arm, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN predicted = 'UNPARSEABLE' THEN n ELSE 0 END) AS BIGINT) AS n_unparseable,
       round(sum(CASE WHEN predicted = 'UNPARSEABLE' THEN n ELSE 0 END) / sum(n), 6) AS unparseable_rate
FROM oc GROUP BY 1"""
    summary = """,
acc AS (SELECT arm, CAST(sum(n) AS BIGINT) AS n_samples,
        round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n), 6) AS accuracy,
        round(sum(CASE WHEN predicted = 'UNPARSEABLE' THEN n ELSE 0 END) / sum(n), 6) AS unparseable_rate
        FROM oc GROUP BY 1),
f AS (SELECT arm, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1
      FROM cr GROUP BY 1),
summary AS (SELECT arm, n_samples, accuracy, macro_f1, weighted_f1, unparseable_rate
            FROM acc JOIN f USING (arm))"""
    q["metrics_summary"] = H + summary + """
SELECT arm, 'scored-outputs' AS model, 'full table' AS eval_type, n_samples,
       CAST(0 AS BIGINT) AS samples_per_class, accuracy, macro_f1, weighted_f1, unparseable_rate
FROM summary"""
    q["metrics_rounded"] = H + summary + """
SELECT arm, round(accuracy, 3) AS accuracy, round(macro_f1, 3) AS macro_f1,
       round(weighted_f1, 3) AS weighted_f1, round(unparseable_rate, 3) AS unparseable_rate FROM summary"""

    doc = H + summary + """,
mic AS (SELECT arm, sum(tp) AS tp, sum(n_predicted) AS inl, sum(support) AS sup FROM cr GROUP BY 1),
tot AS (SELECT arm, sum(n) AS n_rows FROM oc GROUP BY 1),
mic2 AS (SELECT mic.arm, CASE WHEN inl = n_rows THEN 'accuracy' ELSE 'micro avg' END AS key,
         CASE WHEN inl <> 0 THEN tp / inl ELSE 0.0 END AS p,
         CASE WHEN sup <> 0 THEN tp / sup ELSE 0.0 END AS r, sup
         FROM mic JOIN tot USING (arm)),
ent AS (
  SELECT arm, label AS key, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM cr
  UNION ALL
  SELECT arm, key, p, r, CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0.0 END,
         CAST(sup AS DOUBLE) FROM mic2
  UNION ALL
  SELECT arm, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS DOUBLE)
  FROM cr GROUP BY arm
  UNION ALL
  SELECT arm, 'weighted avg', sum(precision * support) / sum(support),
         sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
         CAST(sum(support) AS DOUBLE) FROM cr GROUP BY arm)
SELECT s.arm, 'scored-outputs' AS model, 'full table' AS eval_type, s.n_samples,
       CAST(0 AS BIGINT) AS samples_per_class, s.accuracy, s.macro_f1, s.weighted_f1,
       s.unparseable_rate, e.key, round(e.precision, 6) AS precision, round(e.recall, 6) AS recall,
       round(e.f1, 6) AS f1, e.support
FROM summary s JOIN ent e USING (arm)"""
    q["metrics_document"] = doc
    q["metrics_reload"] = doc

    E = f"{eval_arms_sql()}{outcomes_cte('arms')}"
    q["arm_comparison"] = E + summary + """,
lng AS (SELECT arm, 'accuracy' AS metric, accuracy AS v FROM summary
        UNION ALL SELECT arm, 'macro_f1', macro_f1 FROM summary
        UNION ALL SELECT arm, 'weighted_f1', weighted_f1 FROM summary
        UNION ALL SELECT arm, 'unparseable_rate', unparseable_rate FROM summary)
SELECT metric, max(CASE WHEN arm = 'zero_shot' THEN v END) AS baseline,
       max(CASE WHEN arm = 'tuned' THEN v END) AS tuned,
       round(max(CASE WHEN arm = 'tuned' THEN v END) - max(CASE WHEN arm = 'zero_shot' THEN v END), 6) AS delta
FROM lng GROUP BY 1"""
    q["document_comparison"] = q["arm_comparison"]
    q["failed_classes"] = E + "\nSELECT arm, label, support, n_predicted FROM cr WHERE f1 = 0"
    q["top_classes"] = E + """
SELECT arm, rank, label, round(f1, 6) AS f1 FROM (
  SELECT arm, label, f1, row_number() OVER (PARTITION BY arm ORDER BY f1 DESC, label) AS rank FROM cr)
WHERE rank <= 1"""
    q["dominant_confusion"] = E + """,
s AS (SELECT arm, actual, sum(n) AS support FROM oc GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY arm, actual ORDER BY n DESC, predicted) AS r
      FROM oc WHERE actual <> predicted)
SELECT w.arm, w.actual, w.predicted, CAST(w.n AS BIGINT) AS n, CAST(s.support AS BIGINT) AS support,
       round(w.n / s.support, 6) AS share FROM w JOIN s USING (arm, actual) WHERE r = 1"""
    q["misses"] = eval_arms_sql() + """
SELECT arm, ticket_id, intent, predicted_intent, md5(instruction) AS text_md5 FROM arms
WHERE predicted_intent IS DISTINCT FROM intent"""
    q["prediction_coverage"] = E + "\nSELECT arm, label, n_predicted, n_predicted > 0 AS ever_predicted FROM cr"
    q["run_agreement"] = eval_arms_sql() + """,
j AS (SELECT a.predicted_intent AS pa, b.predicted_intent AS pb FROM arms a
      JOIN arms b ON a.ticket_id = b.ticket_id WHERE a.arm = 'zero_shot' AND b.arm = 'tuned')
SELECT count(*) AS n_common, count(CASE WHEN pa IS NOT DISTINCT FROM pb THEN 1 END) AS n_agree,
       round(CASE WHEN count(*) > 0 THEN count(CASE WHEN pa IS NOT DISTINCT FROM pb THEN 1 END) / count(*)
             ELSE 0.0 END, 6) AS agreement_rate FROM j"""
    q["class_delta"] = E + """,
b AS (SELECT label, f1 AS f1_baseline FROM cr WHERE arm = 'zero_shot'),
t AS (SELECT label, f1 AS f1_tuned FROM cr WHERE arm = 'tuned'),
j AS (SELECT coalesce(b.label, t.label) AS label, coalesce(f1_baseline, 0.0) AS fb,
      coalesce(f1_tuned, 0.0) AS ft FROM b FULL OUTER JOIN t ON b.label = t.label)
SELECT label, round(fb, 6) AS f1_baseline, round(ft, 6) AS f1_tuned, round(ft - fb, 6) AS delta,
       fb = 0 AND ft > 0 AS repaired FROM j"""

    q["validate_requests"] = f"WITH {requests_cte()} SELECT * FROM validated"
    q["validate_props_requests"] = """WITH val AS (SELECT event_id AS request_id, props AS body,
  CASE WHEN NOT json_valid(props) THEN 'malformed'
       WHEN json_type(props) <> 'OBJECT' THEN 'not_object'
       WHEN NOT list_contains(json_keys(props), 'k') THEN 'missing_message' END AS error_kind
  FROM events)
SELECT request_id, error_kind IS NULL AS accepted, error_kind,
  CASE WHEN error_kind IS NULL THEN json_extract_string(body, '$.k') END AS message FROM val"""
    prefix = ERROR_PREFIX.replace("'", "''")
    q["score_requests"] = f"""WITH {requests_cte()},
sv AS (SELECT request_id, message, {strip_ws('message')} AS text,
       CASE WHEN accepted AND (message IS NULL OR length({strip_ws('message')}) = 0) THEN 'blank_message'
            ELSE error_kind END AS error_kind FROM validated),
ok AS (SELECT * FROM sv WHERE error_kind IS NULL){kw_ctes('kw', 'events', 'event_type', 'ok', 'request_id', 'text')}
SELECT ok.request_id, json_object('message', ok.message,
       'predicted_intent', coalesce(k.label, 'UNPARSEABLE'))::VARCHAR AS response
FROM ok LEFT JOIN kw_best k ON k.kid = ok.request_id
UNION ALL
SELECT request_id, json_object('error', '{prefix}' || error_kind)::VARCHAR FROM sv WHERE error_kind IS NOT NULL"""

    routed = (SPLIT + TRAIN + TEST + nb_ctes("nb", "train", "test", "intent") + f""",
tl AS (SELECT list_sort(list_distinct(list(intent))) AS labels FROM train),
routed AS (SELECT p.*, coalesce(list_contains(labels, predicted_intent), false)
           AND confidence >= {ROUTE_THRESHOLD} AS auto FROM nb_pred p, tl)""")
    q["route_tickets"] = routed + """
SELECT ticket_id, intent, predicted_intent, round(confidence, 6) AS confidence, auto,
       CASE WHEN auto THEN predicted_intent ELSE 'route_to_human' END AS routed_to FROM routed"""
    q["automation_rate"] = routed + """
SELECT count(*) AS n_rows, count(CASE WHEN auto THEN 1 END) AS n_auto,
       count(CASE WHEN NOT auto THEN 1 END) AS n_human,
       round(CASE WHEN count(*) > 0 THEN count(CASE WHEN auto THEN 1 END) / count(*) ELSE 0.0 END, 6) AS auto_rate,
       round(CASE WHEN count(CASE WHEN auto THEN 1 END) > 0
             THEN count(CASE WHEN auto AND predicted_intent = intent THEN 1 END) / count(CASE WHEN auto THEN 1 END)
             ELSE 0.0 END, 6) AS auto_accuracy FROM routed"""
    q["out_of_scope_audit"] = (SPLIT + TRAIN + TEST + """,
msgs AS (SELECT ticket_id * 2 AS ticket_id, instruction, true AS in_scope FROM test
         UNION ALL SELECT page_id * 2 + 1, html, false FROM pages)""" + nb_ctes("nb", "train", "msgs", "in_scope") + f""",
tl AS (SELECT list_sort(list_distinct(list(intent))) AS labels FROM train),
r AS (SELECT p.in_scope, p.predicted_intent,
      CASE WHEN coalesce(list_contains(labels, predicted_intent), false) AND confidence >= {ROUTE_THRESHOLD}
           THEN predicted_intent ELSE 'route_to_human' END AS routed_to FROM nb_pred p, tl),
o AS (SELECT 'forced' AS arm, in_scope, predicted_intent AS output FROM r
      UNION ALL SELECT 'routed', in_scope, routed_to FROM r)
SELECT arm, in_scope, count(*) AS n_rows,
       count(CASE WHEN coalesce(list_contains(labels, {strip_ws('output')}), false) THEN 1 END) AS n_label,
       round(count(CASE WHEN coalesce(list_contains(labels, {strip_ws('output')}), false) THEN 1 END) / count(*), 6)
         AS label_share
FROM o, tl GROUP BY 1, 2""")

    def calibrated(bins: int) -> str:
        """pr: held-out predictions; h: the fitted histogram; iso: its isotonic fit, by the
        max-min formula."""
        b = bucket("Q", "ticket_id")
        return f"""WITH t2 AS (SELECT d.doc_id AS ticket_id, text AS instruction, CAST(quality AS VARCHAR) AS intent
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
qtrain AS (SELECT * FROM t2 WHERE {b} < 8), qheld AS (SELECT * FROM t2 WHERE {b} >= 8){nb_ctes("nq", "qtrain", "qheld", "intent")},
pr AS (SELECT CASE WHEN {b} < 12 THEN 'fit' ELSE 'unseen' END AS part, predicted_intent = intent AS ok,
  round(confidence, 6) AS conf, CAST(greatest(0, least(floor(round(confidence, 6) * {bins}), {bins - 1})) AS INTEGER) AS bin FROM nq_pred),
h AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM pr WHERE part = 'fit' GROUP BY bin),
means AS (SELECT a.bin AS a, b.bin AS b, sum(m.k) / sum(m.n) AS v FROM h a JOIN h b ON a.bin <= b.bin
  JOIN h m ON m.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2),
lows AS (SELECT a, i.bin, min(v) AS v FROM means JOIN h i ON i.bin BETWEEN a AND b GROUP BY 1, 2),
iso AS (SELECT bin, max(v) AS v FROM lows GROUP BY 1)"""

    q["reliability"] = calibrated(20) + """,
x AS (SELECT part, bin, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_correct, avg(conf) AS mean FROM pr GROUP BY 1, 2)
SELECT part, bin, n_rows, n_correct, round(mean, 6) AS mean_confidence, round(n_correct / n_rows, 6) AS accuracy,
  round(coalesce((SELECT arg_max(v, iso.bin) FROM iso WHERE iso.bin <= x.bin), (SELECT arg_min(v, iso.bin) FROM iso)), 6)
    AS calibrated FROM x"""
    q["calibrated_routing"] = calibrated(100) + """,
starts AS (SELECT bin FROM (SELECT bin, v, lag(v) OVER (ORDER BY bin) AS p FROM iso) WHERE p IS NULL OR p <> v),
w AS (SELECT CAST(unnest([0.85, 0.9, 0.95, 0.99]) AS DOUBLE) AS wanted),
upto AS (SELECT s.bin, sum(n) AS n, sum(k) AS k FROM starts s JOIN h ON h.bin >= s.bin GROUP BY s.bin),
cut AS (SELECT wanted, min(bin) AS bin FROM w LEFT JOIN upto ON k >= wanted * n GROUP BY wanted)
SELECT wanted, bin / 100.0::DOUBLE AS threshold, count(*) AS n_rows, count(*) FILTER (WHERE p.bin >= cut.bin) AS n_auto,
  round(count(*) FILTER (WHERE p.bin >= cut.bin) / count(*), 6) AS auto_rate,
  round(count(*) FILTER (WHERE p.bin >= cut.bin AND ok) / nullif(count(*) FILTER (WHERE p.bin >= cut.bin), 0), 6) AS auto_accuracy
FROM cut CROSS JOIN (SELECT bin, ok FROM pr WHERE part = 'unseen') p GROUP BY wanted, cut.bin""".replace("SELECT wanted, bin / 100", "SELECT wanted, cut.bin / 100")
    return q


ORACLE_SQL = _q()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
