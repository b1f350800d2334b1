import pytest

from tessera.operators.analysis import analyse

GO = '''package main

import (
	"fmt"
	st "x/store"
)

// Store keeps { things.
type Store struct {
	name string
}

func (s *Store) Get(k string) (string, error) {
	fmt.Println("}{ func fake() {", k)
	return st.Load(k), nil
}

func Run() {
	s := &Store{name: `}`}
	s.Get(helper("a"))
}

func helper(x string) string { return x }
'''
TS = '''import * as path from "node:path";
import Thing, { other } from './thing';
const fs = require("fs");

export class Engine extends Base implements Runner {
  private count: Counter = 0;
  constructor(readonly x: number) { super(); }
  async run(task: Task): Promise<void> {
    const t = `a { ${task} }`;
    return this.step(path.join(t));
  }
}

export function make(o: Options) {
  if (o) { return new Engine(1); }
}

const add = (a: number, b: number) => {
  return other(a, b);
};

interface Runner { run(): void }
type Id = string | number;
'''
C = '''#include <stdio.h>
#include "util/list.h"

struct node {
    int value; /* } */
};

static int
count(struct node *n)
{
    if (n) { return visit(n->value); }
    return 0;
}

int main(int argc, char **argv) {
    printf("{%d}", count(0));
}
'''


def named(path, text):
    chunks, edges = analyse(path, text)
    lines = text.split("\n")
    for content, _, _, _, _, start, end in chunks:  # a chunk is where its lines are
        assert content.split("\n")[0].strip() in lines[start - 1] and content.count("\n") == end - start
    return {(c[3], c[2], c[4]): (c[5], c[6]) for c in chunks if c[3]}, edges


def test_go():
    found, edges = named("a.go", GO)
    assert found == {("Store", "type_declaration", ""): (9, 11), ("Get", "method_declaration", "Store"): (13, 16), ("Run", "function_declaration", ""): (18, 21), ("helper", "function_declaration", ""): (23, 23)}
    assert {e[1:] for e in edges if e[0] == "import"} == {("", "fmt", "", 4), ("st", "x/store", "", 5)}
    assert {e[1:] for e in edges if e[0] == "call"} == {("Get", "Println", "fmt", 14), ("Get", "Load", "st", 15), ("Run", "Get", "s", 20), ("Run", "helper", "", 20)}
    assert ("reference", "Run", "Store", "", 19) in edges


def test_typescript():
    found, edges = named("a.ts", TS)
    assert {k[:2] for k in found} == {("Engine", "export_statement"), ("constructor", "method_definition"), ("run", "method_definition"), ("make", "export_statement"), ("add", "lexical_declaration"), ("Runner", "interface_declaration"), ("Id", "type_alias_declaration")}
    assert found["run", "method_definition", "Engine"] == (8, 11) and found["Engine", "export_statement", ""] == (5, 12)
    assert {e[1:4] for e in edges if e[0] == "import"} == {("path", "node:path", ""), ("Thing", "./thing", ""), ("fs", "fs", "")}
    assert {e[1:3] for e in edges if e[0] == "inherit"} == {("Engine", "Base"), ("Engine", "Runner")}
    assert {("run", "step", "this"), ("run", "join", "path"), ("make", "Engine", ""), ("add", "other", "")} <= {e[1:4] for e in edges if e[0] == "call"}
    assert ("make", "Options") in {e[1:3] for e in edges if e[0] == "reference"}


def test_c():
    found, edges = named("a.c", C)
    assert found == {("node", "struct_specifier", ""): (4, 6), ("count", "function_definition", ""): (8, 13), ("main", "function_definition", ""): (15, 17)}
    assert {e[2] for e in edges if e[0] == "import"} == {"stdio.h", "util/list.h"}
    assert {e[1:3] for e in edges if e[0] == "call"} == {("count", "visit"), ("main", "printf"), ("main", "count")}


@pytest.mark.parametrize("path", ["a.go", "a.js", "a.tsx", "a.c"])
@pytest.mark.parametrize("text", ["", "\n\n", "}}}{{{", "func (", '"unclosed', "/* open", "class {", "`", "// only a remark", "x" * 5000, "{" * 3000])
def test_nothing_fails(path, text):
    chunks, _ = analyse(path, text)
    assert "".join(c[0] for c in chunks).split() == text.split() or len(text) >= 3000
