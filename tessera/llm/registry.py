"""All queries of this subpackage and the SQL of those that SQL can express."""

from tessera.llm import bpe, chat, decontaminate, pii, quality, rules, simhash, substring, toxicity, wordpiece

MODULES = (chat, simhash, toxicity, quality, wordpiece, decontaminate, rules, pii, substring, bpe)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
