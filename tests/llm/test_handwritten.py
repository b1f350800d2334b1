from tessera.llm import handwritten as H

BODY = "def f{0}(a, b):\n    total = load{0}(a, {1})\n    for x in b:\n        total += x.{2} * scale_{0}(x)\n    if total > {1}:\n        raise ValueError('too much of {2}')\n    return [g for g in a if g.{2}_{0} and total]\n"
CHUNKS = "file_path string, start_line int, content string, content_hash string, kind string, print long"


def body(tag):
    return "\n".join(BODY.format(f"{tag}{i}", i * 7, w) for i, w in enumerate(["alpha", "beta", "gamma", "delta"]))


def alone(path, text):
    from tessera.llm.languages import language_of

    language = language_of(path)
    tokens, shapes, head, literal = H.read(text, language)
    return H.kind_by_itself(path, text, tokens, shapes, head, literal, language)


def test_alone():
    own = body("own")
    getters = "".join(f"def get_{w}(m):\n    if m is None:\n        return None\n    return m._fields[{i}]\n\n" for i, w in enumerate("abcdefgh"))
    assert alone("r/a.py", own) is None
    assert alone("r/a.py", "# Code generated by x v1. DO NOT EDIT.\n" + own) == "generated"
    assert alone("r/a.py", own + "\nbanner = 'Code generated by x. DO NOT EDIT.'\n") is None
    assert alone("r/a.py", own + "\n# ids are generated by the server, do not edit them here\n") is None
    assert alone("r/a.py", "# Diese Datei wurde automatisch erzeugt\n" + own) == "generated"
    assert alone("r/x.py", getters) == "generated"
    assert alone("r/x_pb2.py", own) == alone("r/gen/x.py", own) == "generated"
    assert alone("r/generator/x.py", own) is alone("r/vendors/x.py", own) is alone("r/external_audit/x.py", own) is None
    assert alone("r/vendor/pkg/x.py", own) == alone("r/node_modules/p/x.json", "{}") == "vendored"
    assert alone("r/x.min.js", "a") == "minified"
    assert alone("r/x.js", ";".join(f"var e{i}=function(t){{return t?t+{i}:n.q{i}(t)}}" for i in range(60))) == "minified"
    assert alone("r/x.go", "package a\n\nvar D = []byte{\n" + "\n".join("0x1f, 0xe2, 0x33, 0x94," for _ in range(40)) + "\n}\n") == "data"
    assert alone("r/x.js", 'export const image = "' + "aB3x" * 400 + '";') == "data"
    assert alone("r/x.json", "[" + "1," * 900 + "1]") is None
    assert alone("r/x.md", own) is alone("r/x.py", "") is None
    assert alone("r/x.py", "The quick words of a text go on and on " * 40) is None


def test_winnowing_keeps_common_runs():
    a = [f"t{i}" for i in range(100)]
    b = ["x"] * 40 + a[30:70] + ["y"] * 40
    assert set(H.fingerprints(a)) & set(H.fingerprints(b))
    assert H.fingerprints(["a"] * 5) == []


def test_copies(spark):
    lib, mine = body("lib"), body("mine")
    changed = lib.replace("scale_lib1", "scale_other").replace("# x", "")
    borrowed = mine + "\n" + BODY.format("lib0", 0, "alpha")
    rows = [
        ("a/util/x.py", lib, "h1"), ("b/core/y.py", changed, "other"), ("c/own.py", mine, "m"), ("d/z.py", borrowed, "b"), ("e/vendor/q/w.py", body("third"), "m"),
        ("f/n.py", None, None), (None, lib, "h1"), ("g/t.txt", lib, "h1"),
    ]
    rows += [(f"{r}/same.py", body("often"), "o") for r in ("h", "i", "j")] + [("k/once.py", body("once"), "p")] * 2
    chunks = spark.createDataFrame([(p, 1, c, h, "k", 0) for p, c, h in rows], CHUNKS)
    upstream = spark.createDataFrame([("h1", 1), ("h1", 2), (None, 3)], "content_hash string, kind int")
    got = {r["file_path"]: r["kind"] for r in H.file_kinds(chunks, upstream).collect()}
    flagged = {"a/util/x.py", "b/core/y.py", "e/vendor/q/w.py", "h/same.py", "i/same.py", "j/same.py"}
    assert {p for p, k in got.items() if k == "vendored"} == flagged
    assert {p for p, k in got.items() if k is None} == {"c/own.py", "d/z.py", "f/n.py", "g/t.txt", "k/once.py"}
    assert H.file_kinds(chunks.limit(0), upstream.limit(0)).count() == 0
