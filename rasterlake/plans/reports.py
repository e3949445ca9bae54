"""Views and reports over records: CSV, text table, results grid, summary."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.functions import labels as L


def csv_view(records: DataFrame) -> DataFrame:
    """The 22 report columns as strings, in report order, under their titles."""
    c = F.col
    dpi = lambda name: F.coalesce(X.number(c(name)), F.lit(L.NOT_SET))
    deep = lambda value: F.when(c("pixels_analyzed"), value).otherwise(F.lit(""))
    values = [
        c("name"), X.full_name(c("format")), c("extension_name"), c("width"), c("height"), dpi("dpi_x"), dpi("dpi_y"), c("resolution_unit"), c("bits_per_pixel"), c("sample_depth"), c("channels"), c("color_model"), c("compression"), c("compression_code"),
        c("file_size"), c("bytes_read"), X.check_name(c("check")), F.array_join(F.transform("problems", lambda p: p["message"]), "; "), deep(c("pixels.distinct_colors").cast("string")), deep(X.number(c("pixels.entropy"), 3)), deep(X.number(c("pixels.compression_ratio"))), c("path"),
    ]
    return records.select(*(v.cast("string").alias(t) for v, t in zip(values, L.CSV_HEADERS, strict=True)))


def csv_lines(records: DataFrame, separator: str = ";") -> DataFrame:
    """path, line: one report line for each record, quoted in Column expressions."""
    view = csv_view(records)
    return view.select(F.col(f"`{L.CSV_HEADERS[-1]}`").alias("path"), F.concat_ws(separator, *(X.csv_quoted(F.col(f"`{t}`"), separator) for t in L.CSV_HEADERS)).alias("line"))


def _cells(rows: Iterable[Iterable[str]], separator: str) -> str:
    out = io.StringIO()
    writer = csv.writer(out, delimiter=separator, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    writer.writerows(rows)
    return out.getvalue()


def to_csv(records: DataFrame, separator: str = ";") -> str:
    """The whole report as text, by name; for reports that a person reads."""
    rows = csv_view(records.orderBy("name", "path")).toLocalIterator()
    return _cells([L.CSV_HEADERS, *([v or "" for v in r] for r in rows)], separator)


def save_csv(path: str, records: DataFrame, separator: str = ";") -> None:
    """One file with a byte order mark."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(to_csv(records, separator))


def write_csv(path: str, records: DataFrame, separator: str = ";") -> None:
    """The report as a folder of files, written by the executors; for reports of any size."""
    csv_view(records).write.mode("overwrite").csv(path, sep=separator, header=True, escape='"', emptyValue="")


def save_report(path: str, records: DataFrame) -> str:
    """Saves all records, with .csv added to a name without it; refuses an empty report."""
    if records.isEmpty():
        raise ValueError("nothing to save")
    path = path if path.lower().endswith(".csv") else path + ".csv"
    save_csv(path, records)
    return path


def grid(records: DataFrame) -> DataFrame:
    c = F.col
    size = F.when(c("geometry_valid"), F.concat_ws(" x ", "width", "height")).otherwise("")
    colours = F.when(c("pixels_analyzed"), c("pixels.distinct_colors").cast("string")).otherwise("")
    cells = [c("name"), X.short_name(c("format")), size, X.dpi_text(c("dpi_x"), c("dpi_y"), c("resolution_unit")), c("bits_per_pixel"), c("compression"), X.check_name(c("check")), colours]
    return records.select(*(v.cast("string").alias(t, metadata={"comment": L.COLUMN_HELP[t]}) for v, t in zip(cells, L.GRID_HEADERS, strict=True)))


def panel(records: DataFrame) -> DataFrame:
    """path, position, group, name, value, note: what the detail panel shows of a record, rows without a value left out; then its details."""
    c, p = F.col, F.col("pixels")
    deep, mismatch = F.coalesce(c("pixels_analyzed"), F.lit(False)), c("extension_mismatch")

    def row(group: str, name: str, value: Column, given: Column | None = None, note: Column | None = None) -> Column:
        made = F.struct(F.lit(group).alias("group"), F.lit(name).alias("name"), value.cast("string").alias("value"), (F.lit(L.PANEL_NOTES[group, name]) if note is None else note).alias("note"))
        return made if given is None else F.when(given, made)

    signature = F.concat_ws(" ", *(F.substring(F.hex("signature"), 2 * i + 1, 2) for i in range(8)))
    two = lambda x: X.fixed(x, 2)
    note = lambda group, name, other, when: F.when(when, F.lit(other)).otherwise(F.lit(L.PANEL_NOTES[group, name]))
    rows = F.array(
        row("Файл", "Имя", c("name")), row("Файл", "Папка", c("folder")), row("Файл", "Размер", X.human_size_details(c("file_size"))), row("Файл", "Прочитано байт", c("bytes_read")),
        row("Формат", "Сигнатура", signature), row("Формат", "Определён как", X.full_name(c("format"))), row("Формат", "Расширение", c("extension_name"), None, note("Формат", "Расширение", L.PANEL_MISMATCH, mismatch)),
        row("Размер", "Ширина", F.concat(c("width").cast("string"), F.lit(" px")), c("geometry_valid")), row("Размер", "Высота", F.concat(c("height").cast("string"), F.lit(" px")), c("geometry_valid")),
        row("Размер", "Разрешение", F.when(c("dpi_known"), F.concat_ws(" x ", two(c("dpi_x")), two(c("dpi_y")))).otherwise(L.NOT_SET), None, note("Размер", "Разрешение", L.PANEL_NO_DPI, ~c("dpi_known"))), row("Размер", "Единицы", c("resolution_unit"), c("dpi_known")),
        row("Глубина", "Бит на пиксель", c("bits_per_pixel"), c("bits_per_pixel") > 0), row("Глубина", "Бит на канал", c("sample_depth"), c("sample_depth") > 0), row("Глубина", "Каналы", c("channels"), c("channels") > 0),
        row("Глубина", "Модель цвета", c("color_model"), c("color_model") != ""), row("Сжатие", "Метод", c("compression"), c("compression") != ""), row("Сжатие", "Код", c("compression_code"), c("compression_code") != ""),
        row("Проверка", "Статус", X.check_name(c("check")), None, note("Проверка", "Статус", L.PANEL_SEE_BELOW, c("check") != "OK")),
    )
    problems = F.transform("problems", lambda x: F.struct(F.lit("Проверка").alias("group"), F.lit("Замечание").alias("name"), x["message"].alias("value"), F.lit(L.PANEL_NOTES["Проверка", "Замечание"]).alias("note")))
    pixels = F.array(
        row("Пиксели", "Декодер", c("format"), deep), row("Пиксели", "Всего цветов", p["distinct_colors"], deep), row("Пиксели", "Оттенки серого", X.yes_no(p["grayscale"]), deep),
        row("Пиксели", "Прозрачность", F.when(p["alpha_used"], L.PANEL_ALPHA_USED).otherwise(X.yes_no(F.lit(False))), deep), *(row("Пиксели", f"Средний {x}", X.mean_text(p["mean_channel"][i]), deep) for i, x in enumerate("RGB")),
        row("Пиксели", "Энтропия", X.mean_text(p["entropy"]), deep), row("Пиксели", "Коэффициент сжатия", F.concat(X.mean_text(p["compression_ratio"]), F.lit(" : 1")), deep & (p["compression_ratio"] > 0)),
    )
    more = F.transform("details", lambda d: F.struct(d["group"].alias("group"), d["name"].alias("name"), d["value"].alias("value"), F.lit("").alias("note")))
    whole = F.filter(F.concat(rows, problems, pixels, more), lambda x: x.isNotNull())
    return records.select("path", F.posexplode(whole).alias("position", "x")).select("path", "position", "x.*")


def to_text_table(records: DataFrame) -> str:
    widths = (40, 8, 12, 19, 8, 21)
    titles = L.TEXT_HEADERS
    lines = [" ".join([*(t.ljust(w) for t, w in zip(titles, widths, strict=False)), titles[-1]]), "-" * 120]
    c = F.col
    rows = records.orderBy("name", "path").select(
        c("name"), X.short_name(c("format")).alias("f"), F.when(c("geometry_valid"), F.concat_ws(" x ", "width", "height")).otherwise("н/д").alias("g"),
        F.when(c("dpi_known"), F.concat_ws(" x ", X.number(c("dpi_x")), X.number(c("dpi_y")))).otherwise(L.NOT_SET).alias("r"), c("bits_per_pixel").cast("string").alias("b"), c("compression").alias("k"), X.check_name(c("check")).alias("s"), F.transform("problems", lambda p: p["message"]).alias("p"),
    )
    for r in rows.toLocalIterator():
        name = r["name"] if len(r["name"].encode()) <= 37 else r["name"].encode()[:34].decode("utf-8", "ignore") + "..."
        cells = (name, r["f"], r["g"], r["r"], r["b"], r["k"])
        lines.append(" ".join([*(v.ljust(w) for v, w in zip(cells, widths, strict=True)), r["s"]]))
        lines += [f"    ! {p}" for p in r["p"]]
    return "\n".join(lines) + "\n"
