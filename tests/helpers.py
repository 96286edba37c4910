import contextlib
import io
import re


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def read_schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", text)


def set_conf(spark, **values):
    """Set session settings for one block; names with ``__`` for dots."""

    @contextlib.contextmanager
    def block():
        named = {k.replace("__", "."): v for k, v in values.items()}
        before = {k: spark.conf.get(k, None) for k in named}
        for k, v in named.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return block()
