"""Frameworks of decorators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which framework a decorator belongs to, by the languages it is known in.
WEB = ("typescript", "tsx", "javascript")
FRAMEWORKS = {
    "nestjs": (WEB, "Controller Injectable Module Get Post Put Delete Patch Guard UseGuards Interceptor UseInterceptors Pipe UsePipes Middleware Body Param Query Headers Inject"),
    "angular": (WEB, "Component NgModule Directive Input Output ViewChild HostListener"),
    "flask": (("python",), "app.route bp.route app.before_request app.after_request"),
    "fastapi": (("python",), "router.get router.post router.put router.delete router.patch app.get app.post app.put app.delete"),
    "django": (("python",), "login_required permission_required csrf_exempt require_http_methods"),
    "pytest": (("python",), "pytest.fixture pytest.mark.parametrize pytest.mark.skip pytest.mark.skipif"),
    "actix": (("rust",), "get post put delete patch head"),
    "rocket": (("rust",), "rocket::get rocket::post"),
    "std": (("rust",), "derive cfg test"),
    "tokio": (("rust",), "tokio::test"),
    "async-trait": (("rust",), "async_trait"),
    "encoding/json": (("go",), "json"),
    "encoding/xml": (("go",), "xml"),
    "gopkg.in/yaml": (("go",), "yaml"),
    "gorm": (("go",), "gorm"),
    "go-playground/validator": (("go",), "validate"),
    "mapstructure": (("go",), "mapstructure"),
    "mongo-driver": (("go",), "bson"),
    "go-tools": (("go",), "go:generate"),
    "go-embed": (("go",), "go:embed"),
    "go-build": (("go",), "go:build"),
}


def _registry() -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    out: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for framework, (languages, names) in FRAMEWORKS.items():
        for n in names.split():
            out.setdefault(n, []).append((framework, languages))
    return out


def lookup_framework(decorator: str, language: str | None) -> str | None:
    """The framework that knows a decorator in this language, else the first that knows it at all."""
    known = _registry().get(decorator, [])
    return next((f for f, ls in known if language in ls), known[0][0] if known else None)


def framework(decorator: F.Column, language: F.Column) -> F.Column:
    """The same as an expression over two map literals."""
    first, exact = {}, {}
    for name, entries in _registry().items():
        first[name] = entries[0][0]
        for f, languages in entries:
            for x in languages:
                exact.setdefault(f"{x} {name}", f)
    literal = lambda d: F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])
    return F.coalesce(F.try_element_at(literal(exact), F.concat_ws(" ", language, decorator)), F.try_element_at(literal(first), decorator))


def with_frameworks(symbols: DataFrame, language: str = "language") -> DataFrame:
    """symbols with frameworks filled in where a decorator has none; other fields stay."""
    return symbols.withColumn("decorators", F.transform("decorators", lambda d: d.withField("framework", F.coalesce(d["framework"], framework(d["name"], F.col(language))))))
