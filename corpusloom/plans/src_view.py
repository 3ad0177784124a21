"""SRC: a corpus of source files derived from the `documents` table.

Paths, extensions, methods with known branch counts and planted secrets follow from
doc_id; the document text becomes the closing comment of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread

SPARK_SQL = r"""
with a as (select doc_id, text, lang, source,
  case doc_id % 6 when 0 then '.java' when 1 then '.kt' when 2 then '.py' when 3 then '.go' when 4 then '.md' else '.js' end as ext,
  case doc_id % 5 when 0 then 'Controller' when 1 then 'ServiceImpl' when 2 then 'Repository' when 3 then 'Entity' else 'Util' end as kind,
  case doc_id % 8 when 0 then concat('  String k = "AKIA', lpad(cast(doc_id as string), 16, '0'), '";', '\n')
    when 1 then concat('  String t = "ghp_', lpad(cast(doc_id as string), 36, '0'), '";', '\n')
    when 2 then concat('  password = "pw', lpad(cast(doc_id as string), 8, '0'), '";', '\n')
    when 3 then concat('  String u = "jdbc:postgresql://usr:pw', cast(doc_id as string), '@db.internal/app";', '\n')
    when 4 then concat('  api_key = "sk-ant-', lpad(cast(doc_id as string), 24, '0'), '";', '\n')
    when 5 then case doc_id % 40 when 5 then concat('-----BEGIN RSA PRIVATE KEY-----', '\n', 'MIIE', lpad(cast(doc_id as string), 40, 'k'), '\n', '-----END RSA PRIVATE KEY-----', '\n')
      when 13 then concat('  String o = "sk-', lpad(cast(doc_id as string), 32, 'a'), '";', '\n')
      when 21 then concat('  String g = "AIza', lpad(cast(doc_id as string), 35, 'g'), '";', '\n')
      when 29 then concat('  String s = "xoxb-', lpad(cast(doc_id as string), 24, '7'), '";', '\n')
      else concat('  String j = "eyJ', lpad(cast(doc_id as string), 12, 'h'), '.eyJ', lpad(cast(doc_id as string), 12, 'p'), '.', lpad(cast(doc_id as string), 20, 's'), '";', '\n') end
    else '' end as secret,
  concat_ws('', transform(if(doc_id % 4 = 0, cast(array() as array<bigint>), sequence(cast(1 as bigint), doc_id % 4)), j -> concat('  public int m', cast(j as string), '(int x) {', repeat(' if (x > 0) { x++; }', cast((doc_id * 7 + j * 3) % 23 as int)), ' return x; }\n'))) as methods from documents),
b as (select doc_id, lang, source, ext,
  concat(case doc_id % 7 when 0 then concat('src/test/java/com/acme/', source, '/')
     when 1 then 'build/gen/' when 2 then concat('lib/', lang, '/', source, '/') when 3 then ''
     else concat('src/main/java/com/acme/', source, '/', lang, '/') end,
     kind, cast(doc_id as string), case when doc_id % 11 = 0 then 'Test' else '' end, ext) as rel_path,
  concat('package com.acme.', source, ';', '\n', 'public class ', kind, cast(doc_id as string), ' {', '\n', secret, methods, '}', '\n', '/* ', text, ' */', '\n') as content from a)
select *, octet_length(content) as size_bytes from b
"""

DUCKDB_SQL = r"""
with a as (select doc_id, text, lang, source,
  case doc_id % 6 when 0 then '.java' when 1 then '.kt' when 2 then '.py' when 3 then '.go' when 4 then '.md' else '.js' end as ext,
  case doc_id % 5 when 0 then 'Controller' when 1 then 'ServiceImpl' when 2 then 'Repository' when 3 then 'Entity' else 'Util' end as kind,
  case doc_id % 8 when 0 then concat('  String k = "AKIA', lpad(cast(doc_id as varchar), 16, '0'), '";', chr(10))
    when 1 then concat('  String t = "ghp_', lpad(cast(doc_id as varchar), 36, '0'), '";', chr(10))
    when 2 then concat('  password = "pw', lpad(cast(doc_id as varchar), 8, '0'), '";', chr(10))
    when 3 then concat('  String u = "jdbc:postgresql://usr:pw', cast(doc_id as varchar), '@db.internal/app";', chr(10))
    when 4 then concat('  api_key = "sk-ant-', lpad(cast(doc_id as varchar), 24, '0'), '";', chr(10))
    when 5 then case doc_id % 40 when 5 then concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), 'MIIE', lpad(cast(doc_id as varchar), 40, 'k'), chr(10), '-----END RSA PRIVATE KEY-----', chr(10))
      when 13 then concat('  String o = "sk-', lpad(cast(doc_id as varchar), 32, 'a'), '";', chr(10))
      when 21 then concat('  String g = "AIza', lpad(cast(doc_id as varchar), 35, 'g'), '";', chr(10))
      when 29 then concat('  String s = "xoxb-', lpad(cast(doc_id as varchar), 24, '7'), '";', chr(10))
      else concat('  String j = "eyJ', lpad(cast(doc_id as varchar), 12, 'h'), '.eyJ', lpad(cast(doc_id as varchar), 12, 'p'), '.', lpad(cast(doc_id as varchar), 20, 's'), '";', chr(10)) end
    else '' end as secret,
  coalesce(array_to_string(list_transform(range(1, doc_id % 4 + 1), lambda j: concat('  public int m', cast(j as varchar), '(int x) {', repeat(' if (x > 0) { x++; }', cast((doc_id * 7 + j * 3) % 23 as int)), ' return x; }', chr(10))), ''), '') as methods from documents),
b as (select doc_id, lang, source, ext,
  concat(case doc_id % 7 when 0 then concat('src/test/java/com/acme/', source, '/')
     when 1 then 'build/gen/' when 2 then concat('lib/', lang, '/', source, '/') when 3 then ''
     else concat('src/main/java/com/acme/', source, '/', lang, '/') end,
     kind, cast(doc_id as varchar), case when doc_id % 11 = 0 then 'Test' else '' end, ext) as rel_path,
  concat('package com.acme.', source, ';', chr(10), 'public class ', kind, cast(doc_id as varchar), ' {', chr(10), secret, methods, '}', chr(10), '/* ', text, ' */', chr(10)) as content from a)
select *, strlen(content) as size_bytes from b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def src(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """SRC as a corpus: doc_id, path, size_bytes, content.

    `heavy` is for text work: a small input is spread over the cores first.
    """
    documents = table(spark, sf_dir, "documents")
    if heavy:
        documents = spread(documents, "doc_id")
    # Braces of the statement are text; only the table is a parameter.
    statement = SPARK_SQL.replace("{", "{{").replace("}", "}}")
    statement = statement.replace("from documents", "from {documents}")
    return spark.sql(statement, documents=documents).selectExpr(
        "doc_id", "rel_path as path", "cast(size_bytes as bigint) size_bytes", "content"
    )
