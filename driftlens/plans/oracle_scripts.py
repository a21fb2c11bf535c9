"""SQL that finds the first syntax error of a script: it takes one token a step from the front of the text."""

BLANK = r"[\s\x{0B}]"
WORD = r"[\w$\x{80}-\x{10FFFF}]"
#: What a token may be where code is expected. A literal that does not end is none of them.
TOKEN = (
    rf"^(?:{WORD}+|//[^\r\n]*|/\*(?s:.*?)\*/|""" + '"' + r"""(?:\\\r\n|\\(?s:.)|[^"\\\r\n])*""" + '"' + r"""|'(?:\\\r\n|\\(?s:.)|[^'\\\r\n])*'"""
    r"|\\\r\n|\\(?s:.)|=+>|\+{2,}|-{2,}|\*/|(?s:.))"
).replace("'", "''")
PATTERN = r"^/(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/"
TEMPLATE = r"^((?:\\(?s:.)|[^`\\$]|\$+[^`\\${]|\$+\\(?s:.))*\$*)(`|\$\{)"
TOP, BELOW = "right(st, 1)", "left(st, length(st) - 1)"
OPERANDS = "'return', 'typeof', 'case', 'delete', 'void', 'throw', 'new', 'in', 'of', 'instanceof', 'yield', 'await', 'extends', 'default'"

SCRIPT_ERRORS = rf"""WITH RECURSIVE t AS (
  SELECT 'documents' AS name, 'f' || doc_id || '.js' AS path, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'pages', 'f' || page_id || '.js', coalesce(html, '') FROM pages),
r(name, path, rest, pos, m, st, b, p, s0, e, ea) USING KEY (name, path) AS (
  SELECT name, path, text, CAST(1 AS BIGINT), 'c', '', 's', ' ', CAST(1 AS BIGINT), '', CAST(0 AS BIGINT) FROM t
  UNION
  SELECT name, path, substr(body, length(took) + 1), pos + length(took),
    CASE WHEN m = 't' AND (ends = '`' OR ends = '${{') OR m = 'c' AND NOT (took = '`' OR (took = '}}' AND {TOP} = '$')) THEN 'c' ELSE 't' END,
    CASE WHEN m = 't' THEN CASE WHEN ends = '${{' THEN st || '$' ELSE st END
      WHEN took = '(' THEN st || CASE WHEN b = 'i' THEN 'i' ELSE '(' END WHEN took = '[' THEN st || '['
      WHEN took = '{{' THEN st || CASE WHEN b = 'x' THEN 'o' ELSE '{{' END WHEN took IN (')', ']', '}}') THEN {BELOW} ELSE st END,
    CASE WHEN m = 't' THEN CASE WHEN ends = '${{' THEN 'x' ELSE 'v' END
      WHEN took = '' OR left(took, 2) IN ('//', '/*') AND NOT pattern OR took = '`' THEN b
      WHEN pattern THEN CASE WHEN length(took) > length(lit) THEN 'x' ELSE 'v' END
      WHEN regexp_matches(took, '^{WORD}') THEN CASE WHEN p = '.' THEN 'v' WHEN took IN ({OPERANDS}) THEN 'x' WHEN took IN ('else', 'do', 'try', 'finally') THEN 's'
        WHEN took IN ('if', 'while', 'for', 'with') THEN 'i' ELSE 'v' END
      WHEN left(took, 1) = '\' THEN CASE WHEN took = '\' OR regexp_matches(took, '^.(?:{WORD}|\\|{BLANK})') THEN 'v' ELSE 'x' END
      WHEN took = ')' THEN CASE WHEN {TOP} = 'i' THEN 's' ELSE 'v' END WHEN took = ']' OR left(took, 1) IN ('"', '''') OR left(took, 2) IN ('++', '--') THEN 'v'
      WHEN took = '}}' THEN CASE {TOP} WHEN '{{' THEN 's' WHEN 'o' THEN 'v' ELSE b END WHEN took IN ('{{', ';') OR took LIKE '=%>' THEN 's' ELSE 'x' END,
    CASE WHEN left(took, 1) = '\' THEN '' ELSE right(took, 1) END,
    CASE WHEN m = 'c' AND (took = '`' OR (took = '}}' AND {TOP} = '$')) THEN pos ELSE s0 END,
    error, CASE WHEN error <> '' THEN CASE WHEN m = 't' THEN s0 ELSE pos END ELSE 0 END
  FROM (
    SELECT *, CASE
      WHEN m = 't' THEN CASE WHEN ends = '' THEN 'Unterminated template' ELSE '' END
      WHEN took IN ('"', '''') THEN 'Unterminated string constant' WHEN slash AND took = '/' AND left(body, 2) = '/*' THEN 'Unterminated comment'
      WHEN slash AND b <> 'v' AND left(body, 2) NOT IN ('//', '/*') AND lit = '' THEN 'Unterminated regular expression'
      WHEN took = '*/' OR took = ')' AND {TOP} NOT IN ('(', 'i') OR took = ']' AND {TOP} <> '[' OR took = '}}' AND {TOP} NOT IN ('{{', 'o', '$') THEN 'Unexpected token'
      ELSE '' END AS error
    FROM (
      SELECT *, CASE WHEN m = 't' THEN plain WHEN pattern THEN lit || CASE WHEN regexp_matches(body[length(lit) + 1:], '^[/*]') AND lit[-2] <> '*' THEN body[length(lit) + 1] ELSE '' END
        ELSE regexp_extract(body, '{TOKEN}') END AS took
      FROM (
        SELECT *, slash AND b <> 'v' AND left(body, 2) NOT IN ('//', '/*') AND lit <> '' AS pattern, CASE WHEN m = 't' THEN regexp_extract(body, '{TEMPLATE}', 2) ELSE '' END AS ends
        FROM (
          SELECT *, m = 'c' AND left(body, 1) = '/' AS slash, CASE WHEN m = 'c' AND left(body, 1) = '/' THEN regexp_extract(body, '{PATTERN}') ELSE '' END AS lit,
            CASE WHEN m = 't' THEN regexp_extract(body, '{TEMPLATE}') ELSE '' END AS plain
          FROM (
            SELECT name, path, m, st, b, s0, CASE WHEN m = 'c' THEN regexp_replace(rest, '^{BLANK}+', '') ELSE rest END AS body,
              pos + length(rest) - length(body) AS pos, CASE WHEN length(body) < length(rest) THEN ' ' ELSE p END AS p
            FROM r WHERE e = '' AND rest <> '')))))
),
f AS (SELECT name, path, CASE WHEN e <> '' THEN e WHEN m = 't' THEN 'Unterminated template' WHEN st <> '' THEN 'Unexpected token' END AS e,
    CASE WHEN e <> '' THEN ea WHEN m = 't' THEN s0 ELSE pos END AS ea FROM r),
g AS (SELECT name, path, e, string_split_regex(substr(text, 1, ea - 1), '\r\n|\n|\r') AS lines FROM f JOIN t USING (name, path) WHERE e IS NOT NULL)
SELECT name, path, e || '. (' || len(lines) || ':' || length(lines[-1]) || ')' AS parse_error FROM g"""
