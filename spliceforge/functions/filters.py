"""Named filters: Python-like boolean expressions compiled to columns, never evaluated as code."""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXTS = ("gene", "transcript", "reference")
#: The novelty categories and their subcategories.
CATEGORY_NAMES = ("FSM", "ISM", "NIC", "NNC", "NOVEL")
SUBCATEGORIES = (
    "5' fragment", "3' fragment", "mono-exon", "exon skipping", "intron retention", "novel combination", "novel junction", "novel exonic TSS", "novel exonic PAS",
    "novel 5' splice site", "novel 3' splice site", "novel exon", "novel intronic TSS", "novel intronic PAS", "readthrough fusion", "genic genomic", "intronic", "antisense", "intergenic",
)

_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}


def tag_name(sub: str) -> str:
    """Tag of a subcategory: upper-case words joined by underscores; a leading digit gets one before it."""
    tag = "_".join(re.findall(r"\w+", sub)).upper()
    return f"_{tag}" if tag[0].isdigit() else tag


class FilterError(ValueError):
    pass


class Filters:
    """Registry of tags by context; a tag's expression is over column names, a query's over tags of its context."""

    def __init__(self) -> None:
        self.tags: dict[str, dict[str, str]] = {c: {} for c in CONTEXTS}

    def add(self, tag: str, expression: str, context: str = "transcript", update: bool = False) -> None:
        if not re.fullmatch(r"\w+", tag):
            raise FilterError(f"{tag!r} isn't one word")
        if context not in CONTEXTS:
            raise FilterError(f"no context {context!r}")
        if not update and any(tag in t for t in self.tags.values()):
            raise FilterError(f"{tag} exists already")
        ast.parse(expression, mode="eval")
        for t in self.tags.values():
            t.pop(tag, None)
        self.tags[context][tag] = expression

    def remove(self, tag: str) -> None:
        if not any(t.pop(tag, None) for t in self.tags.values()):
            raise FilterError(f"no tag {tag}")

    def column(self, tag: str, context: str = "transcript") -> Column:
        """A tag as a boolean column that is never null: what is unknown doesn't hold."""
        return F.coalesce(truth(compile_expression(self.tags[context][tag])), F.lit(False))

    def query(self, text: str, *contexts: str) -> Column:
        """A boolean expression over the tags of ``contexts`` (transcript and gene by default)."""
        known = {tag: c for c in contexts or ("transcript", "gene") for tag in self.tags[c]}

        def name(n: str) -> Column:
            if n not in known:
                raise FilterError(f"no tag {n}")
            return self.column(n, known[n])

        return F.coalesce(truth(_Compiler(name).compile(text)), F.lit(False))


def default_filters() -> Filters:
    """The tags of the domain: columns are exons, a_content, category, subs, noncanonical, novel_sites, fragments, coverage, gene_coverage."""
    f = Filters()
    for tag, e in (("NOVEL_GENE", "not is_annotated"), ("EXPRESSED", "n_transcripts > 0"), ("CHIMERIC", "is_chimeric")):
        f.add(tag, e, "gene")
    for tag, e in (("REF_UNSPLICED", "len(exons) == 1"), ("REF_MULTIEXON", "len(exons) > 1"), ("REF_INTERNAL_PRIMING", "a_content > .5")):
        f.add(tag, e, "reference")
    for tag, e in (
        ("INTERNAL_PRIMING", "len(exons) == 1 and a_content > .5"), ("NONCANONICAL_SPLICING", "len(noncanonical) > 0"), ("NOVEL_TRANSCRIPT", "category > 0"),
        ("FRAGMENT", "len(fragments) > 0 and (has(subs, 'novel exonic TSS') or has(subs, 'novel exonic PAS') or has(subs, \"5' fragment\") or has(subs, \"3' fragment\"))"),
        ("RTTS", "overlap(noncanonical, novel_introns)"), ("UNSPLICED", "len(exons) == 1"), ("MULTIEXON", "len(exons) > 1"), ("SUBSTANTIAL", "coverage > .01 * gene_coverage"),
    ):
        f.add(tag, e)
    for i, c in enumerate(CATEGORY_NAMES):
        f.add(c, f"category == {i}")
    for s in SUBCATEGORIES:
        f.add(tag_name(s), f"has(subs, {s!r})")
    return f


def compile_expression(text: str) -> Column:
    return _Compiler(F.col).compile(text)


def truth(value: Column) -> Column:
    return value.cast("boolean")


class _Compiler:
    """Names, constants, comparisons, and / or / not, is None, in, arithmetic, and the calls len, abs, min, max, has, overlap."""

    def __init__(self, name):
        self.name = name

    def compile(self, text: str) -> Column:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise FilterError(f"{text!r}: {e.msg}") from None
        return self.of(tree.body)

    def of(self, n: ast.AST) -> Column:
        match n:
            case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
                return F.lit(v)
            case ast.Name(id=i):
                return self.name(i)
            case ast.BoolOp(op=op, values=values):
                parts = [F.coalesce(truth(self.of(v)), F.lit(False)) for v in values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.UnaryOp(op=ast.Not(), operand=o):
                return ~F.coalesce(truth(self.of(o)), F.lit(False))
            case ast.UnaryOp(op=ast.USub(), operand=o):
                return -self.of(o)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](self.of(a), self.of(b))
            case ast.Compare(left=left, ops=ops, comparators=rights):
                out, a = None, left
                for op, b in zip(ops, rights):
                    one = self.comparison(a, op, b)
                    out, a = one if out is None else out & one, b
                return out
            case ast.Subscript(value=v, slice=ast.Constant(value=k)):
                base = self.of(v)
                return F.get(base, F.lit(k)) if isinstance(k, int) and k >= 0 else F.try_element_at(base, F.lit(k))
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]):
                return self.call(f, [self.of(a) for a in args])
        raise FilterError(f"{ast.unparse(n)!r} can't be used in a filter")

    def comparison(self, a: ast.AST, op: ast.cmpop, b: ast.AST) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(b, ast.Constant) and b.value is None:
            x = self.of(a)
            return x.isNull() if isinstance(op, ast.Is) else x.isNotNull()
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(b, (ast.Tuple, ast.List, ast.Set)):
                hit = F.coalesce(self.of(a).isin([e.value for e in b.elts]), F.lit(False))
            else:
                hit = F.coalesce(F.array_contains(self.of(b), self.of(a)), F.lit(False))
            return hit if isinstance(op, ast.In) else ~hit
        if type(op) not in _COMPARE:
            raise FilterError("only is None, in and plain comparisons can be used")
        return _COMPARE[type(op)](self.of(a), self.of(b))

    def call(self, f: str, args: list[Column]) -> Column:
        known = {
            ("len", 1): lambda x: F.when(x.isNull(), F.lit(0)).otherwise(F.size(x)), ("abs", 1): F.abs, ("min", 2): F.least, ("max", 2): F.greatest,
            ("has", 2): lambda x, v: F.coalesce(F.array_contains(x, v), F.lit(False)), ("overlap", 2): lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False)),
        }
        if (f, len(args)) not in known:
            raise FilterError(f"no function {f} of {len(args)}")
        return known[f, len(args)](*args)
