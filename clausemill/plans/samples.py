"""Texts made from the tables, by SQL that Spark and other engines read alike: the supplied
documents hold no headings, lists, clauses or claim questions."""

NL = "chr(10)"

#: (doc_id, text): a small document with headings, a list and a table for each order.
STRUCTURED = f"""SELECT o_orderkey AS doc_id, '# Order ' || o_orderkey || {NL} || 'An opening paragraph for the order, in several plain words.' || {NL} || {NL}
 || '## Terms ' || (o_orderkey % 5) || {NL} || (o_orderkey % 9 + 1) || '.' || (o_orderkey % 4) || ' Delivery of goods' || {NL} || '- first item' || {NL} || '- second item of ' || o_custkey || {NL} || {NL}
 || '1. numbered start' || {NL} || 'A line between.' || {NL} || '| a | b |' || {NL} || '| 1 | 2 |' || {NL} || '| 3 | ' || o_orderkey || ' |' || {NL} || 'GENERAL TERMS' || {NL} || {NL}
 || '# Closing' || {NL} || 'The closing text of the agreement stands here. ' || repeat('More words of it follow! ', o_orderkey % 60) AS text FROM orders"""

#: (doc_id, page, text): the same documents on two pages; the break may fall within a line.
PAGED = f"""SELECT doc_id, 1 AS page, left(text, 120) AS text FROM ({STRUCTURED}) a UNION ALL SELECT doc_id, 2 AS page, substr(text, 121) AS text FROM ({STRUCTURED}) b"""

#: (clause_id, policy, kind, text): a clause for each order.
CLAUSES = """SELECT o_orderkey AS clause_id, 'policy ' || (o_custkey % 50) AS policy, CASE o_orderkey % 5 WHEN 0 THEN 'coverage' WHEN 1 THEN 'exclusion' WHEN 2 THEN 'waiting_period' WHEN 3 THEN 'condition' ELSE 'other' END AS kind,
 CASE o_orderkey % 12
 WHEN 0 THEN '1.2 The party shall pay a fee of $' || CAST(FLOOR(o_totalprice) AS BIGINT) || ' within 30 days of invoice under Section ' || (o_orderkey % 7 + 1) || '.' || (o_orderkey % 3) || ' of this agreement.'
 WHEN 1 THEN '"Premium" means the payment defined as the sum set out in Schedule B for the purposes of this contract, hereunder.'
 WHEN 2 THEN '(a) The insurer may terminate this agreement upon breach or default by the party, with notice of termination.'
 WHEN 3 THEN 'Each party keeps CONFIDENTIAL DATA secret and must not disclose proprietary facts, subject to Clause ' || (o_orderkey % 9 + 1) || '.'
 WHEN 4 THEN 'ARTICLE IV. The governing law is that of the courts of the state, and its jurisdiction settles any dispute in this agreement.'
 WHEN 5 THEN 'The insurer is liable for damages and loss, and the liability is limited to Rs ' || (o_orderkey % 900 + 100) || ',000 for knee surgery, which is covered and payable.'
 WHEN 6 THEN 'Force majeure or an act of god, such as war or a pandemic, excuses a delay where the contract permits it, see subsection (b) above.'
 WHEN 7 THEN 'Cosmetic surgery is excluded and not covered. Claims for it are not eligible under any section.'
 WHEN 8 THEN 'A waiting period of ' || (o_orderkey % 30 + 1) || ' months applies after the policy starts, for knee surgery and dental care.'
 WHEN 9 THEN 'Maternity benefits are payable up to ' || (o_orderkey % 5 + 1) || ' lakh, with a co-pay of ' || (o_orderkey % 20) || '% for room rent.'
 WHEN 10 THEN 'Dental treatment is covered in a network hospital, limit Rs 20,000, if the age is below 60.'
 ELSE 'Short note ' || o_orderkey END AS text FROM orders"""

#: (claim_id, question): a claim question for each customer.
QUESTIONS = """SELECT c_custkey AS claim_id, CASE c_custkey % 6
 WHEN 0 THEN (c_custkey % 60 + 20) || '-year-old male, knee surgery in Pune, ' || (c_custkey % 48 + 1) || '-month-old insurance policy'
 WHEN 1 THEN 'Female, age ' || (c_custkey % 50 + 18) || ', dental extraction in Mumbai at Apollo hospital, Rs ' || (c_custkey % 90 + 10) || ',000 claimed'
 WHEN 2 THEN 'Patient claims INR 50,000 for accident treatment in Delhi, policy is ' || (c_custkey % 20 + 1) || ' months old'
 WHEN 3 THEN 'Surgery performed on 12/06/2025 in Chennai for a woman of ' || (c_custkey % 40 + 30) || ' years'
 WHEN 4 THEN 'Maternity delivery, 2 year policy, mrs Rao from Agra, amount ' || (c_custkey % 70 + 5) || ',500'
 ELSE 'Cataract operation for a lady, policy of ' || (c_custkey % 36 + 1) || ' months' END AS question FROM customer"""


#: Rows of a table that one task makes texts of, at most about.
TASK_ROWS = 50_000


def load(spark, sf_dir: str, sql: str):
    """The rows of one of the texts above, over the tables of ``sf_dir``. A text is a hundred times its
    row, which a file's few splits don't show: rows are dealt by key while they are light, so that all
    cores make texts, a task's share doesn't grow with the table, and a document's parts, once
    exploded, lie in one task and need no shuffle of their own."""
    name, key = ("customer", "c_custkey") if "FROM customer" in sql else ("orders", "o_orderkey")
    source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-source.count() // TASK_ROWS))
    braced = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(braced, source=source.repartition(tasks, key))
