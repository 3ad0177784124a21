from corpusloom import Settings
from corpusloom import fixed_values as fv
from corpusloom.operators import insight
from corpusloom.operators.discover import discover
from corpusloom.operators.insight import with_insight
from corpusloom.operators.records import conforms, rule_based_records

TEXT = """import lombok.Data;
import org.springframework.data.jpa.X;
@Secured("A")
public class FooService {
  public static int ping(Integer id, String name) throws E { if (id > 0) { } return 1; }
  public FooService() { }
  String plain(){ }
}
"""


def record(corpus, text, path="a/FooService.java", **options):
    return rule_based_records(discover(corpus({path: text})), Settings(**options)).first()


def test_insight_of_a_file(corpus):
    got = record(corpus, TEXT)
    seen = got.insight
    assert seen.role == "service interface"
    assert seen.summary == "[dry-run] A service interface (FooService.java)."
    assert seen.external_dependencies == ["Lombok", "Spring Data JPA"]
    assert seen.noteworthy == ["Secured endpoints present"]
    first, constructor, plain = seen.key_methods
    assert first.asDict() == {
        "name": "ping", "signature": "public static int ping(Integer id, String name)",
        "description": "[dry-run heuristic] ping in a service interface.",
        "parameters": ["Integer id", "String name"], "returns": "int", "visibility": "public",
    }
    assert (constructor.signature, constructor.returns, constructor.visibility) == ("public FooService()", None, "public")
    assert (plain.signature, plain.visibility, plain.parameters) == ("String plain()", "package", [])
    assert (got.complexity.function_count, got.analyzed_with_chunking, got.from_cache) == (3, False, False)


def test_a_record_has_the_declared_shape(corpus):
    assert conforms(rule_based_records(discover(corpus({"a.py": "x"}))))


def test_all_methods_or_the_first_ones(corpus):
    many = "\n".join(f"int m{i}(int x) {{ }}" for i in range(30))
    assert [m.name for m in record(corpus, many).insight.key_methods] == [f"m{i}" for i in range(30)]
    capped = with_insight(discover(corpus({"a.java": many})), max_methods=fv.MAX_METHODS).first()
    assert [m.name for m in capped.insight.key_methods] == [f"m{i}" for i in range(12)]


def test_a_file_in_chunks_is_merged(corpus):
    many = "".join(f"int m{i}(int x) {{ }}\n" for i in range(30)) + "int m0(int x) { }\n"
    got = record(corpus, many, chunk_token_budget=40)
    assert got.analyzed_with_chunking
    assert [m.name for m in got.insight.key_methods] == [f"m{i}" for i in range(30)]
    parts = got.insight.summary.split(". ")
    assert len(parts) > 1 and got.insight.summary.count("(FooService.java)") == len(parts)


def test_insight_reads_the_redacted_text(corpus):
    text = 'int f(String password = "lombok-secret") { }'
    got = record(corpus, text)
    assert got.insight.external_dependencies == []
    off = record(corpus, text, redact_secrets=False)
    assert off.insight.external_dependencies == ["Lombok"]


def test_method_table(corpus):
    files = discover(corpus({"a.java": TEXT, "b.java": ""} | {"c.java": "x"}))
    rows = insight.reported_methods(insight.with_insight(files), ["path"]).orderBy("path", "pos").collect()
    assert [(r.path, r.pos, r.name) for r in rows] == [
        ("a.java", 1, "ping"), ("a.java", 2, "FooService"), ("a.java", 3, "plain")
    ]
