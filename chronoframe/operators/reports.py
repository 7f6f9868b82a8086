"""Markdown of plans and montages, one text per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import cell, clock, comma, counted, factor, half_up, percent


def table_row(*values: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(v.cast("string")) for v in values]), F.lit(" |"))


def table(rows: DataFrame, keys: list[str], order: list[str], titles: list[str], values: list[Column]) -> DataFrame:
    """The rows of each job as one table: keys, text."""
    head = "\n".join(["| " + " | ".join(titles) + " |", "|" + " --- |" * len(titles)])
    lines = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, table_row(*values).alias("line")))).alias("lines"))
    return lines.select(*keys, F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def index_table(placed: DataFrame) -> DataFrame:
    """Cuts of each job in order, in source and output time; placed as by placement.placements."""
    span = lambda a, b: F.concat(clock(a), F.lit("–"), clock(b))
    source, output = span(F.col("start"), F.col("end")), span(F.col("offset"), F.col("offset") + F.col("length"))
    return table(placed, ["job"], ["start", "id"], ["Corte", "Original", "Resumen"], [F.col("id"), source, output])


def proposal(estimates: DataFrame) -> DataFrame:
    """A paragraph of each job's estimate (planner.estimate): job, text."""
    target = F.when(F.col("target").isNull(), "sin objetivo").otherwise(F.concat(F.lit("objetivo "), clock(F.col("target"))))
    text = F.concat(
        F.col("cuts").cast("string"), F.when(F.col("cuts") == 1, " corte").otherwise(" cortes"), F.lit(", "), clock(F.col("total")), F.lit(" → "), clock(F.col("output")),
        F.lit(" ("), comma(F.col("percent")), F.lit(" %), "), target, F.lit(": "), F.col("state"),
    )
    return estimates.select("job", text.alias("text"))


def montage_report(marks: DataFrame) -> DataFrame:
    """The greatest distance of each cut and what became of its ends: marks (cut, distance, mark) -> cut, distance, ends, bad."""
    return marks.groupBy("cut").agg(F.max("distance").alias("distance"), F.count(F.lit(1)).alias("ends"), F.count_if(F.col("mark") != "ok").alias("bad"))


def numbered(cuts: DataFrame) -> DataFrame:
    """Cuts with the number that a reader calls them by: the included ones in order, then the reserves."""
    order = Window.partitionBy("job").orderBy(F.col("included").desc(), "start", "id")
    return cuts.withColumn("number", F.row_number().over(order))


def lines(rows: DataFrame, order: list, line: Column, name: str) -> DataFrame:
    """The lines of each job's rows in order: job and, under that name, a list."""
    listed = rows.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    return listed.select("job", F.transform("rows", lambda x: x["line"]).alias(name))


def section(title: str, *head: str) -> list[str]:
    return ["", f"## {title}", "", *head]


def span(a, b) -> Column:
    return F.concat(clock(a), F.lit("–"), clock(b))


# What a reader may answer.
ANSWERS = (
    "- «acepta» o «móntalo» para montar esta versión.", "- El número es el de la columna # de esta propuesta, común a cortes y reservas.", "- «quita el 7 y el 9», «añade el 6», «alarga el 3 diez segundos».",
    "- «añade la parte donde habla de ATEX», «parte el 4», «une 4 y 5».", "- «súbelo al 15 %», «sin acelerar», «no quites pausas en el 12».", "- «vuelve a la v1» o «¿qué has dejado fuera?».",
)
OUTLINE_ANSWERS = (
    "- «acepta» o «adelante» para redactar el documento con este esquema.", "- «quita la 3», «añade lo de ATEX», «junta la 1 y la 2» para cambiarlo.",
    "- «¿qué has dejado fuera?» para ver lo descartado sin crear una versión.",
)


def _document(rows: DataFrame, parts: list) -> Column:
    """The lines of parts, which are strings, text columns or names of lists (with what stands for an empty one), as one text."""
    arrays = []
    for part in parts:
        if isinstance(part, tuple):
            name, none = part
            empty = F.array(*map(F.lit, none)) if none else F.array().cast("array<string>")
            arrays.append(F.when(F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))) > 0, F.col(name)).otherwise(empty))
        else:
            arrays.append(F.array(F.lit(part) if isinstance(part, str) else part))
    return F.array_join(F.concat(*arrays), "\n")


def warning_line(with_cut: bool = True) -> Column:
    where = F.coalesce(F.concat(F.lit(" · corte "), F.col("id").cast("string")), F.lit("")) if with_cut else F.lit("")
    return F.concat(F.lit("- "), F.when(F.col("blocking"), "**bloquea** · ").otherwise(""), F.lit("`"), F.col("code"), F.lit("`"), where, F.lit(" · "), F.col("message"))


def proposal_document(report: DataFrame, cuts: DataFrame, warnings: DataFrame, excluded: DataFrame, alternatives: DataFrame, hints: DataFrame, bars: DataFrame) -> DataFrame:
    """What is read before a plan is accepted: job, text.

    report is planner.estimate with version and name; cuts are numbered, with start, end, priority, phrase, reason, included and for those included out
    and length; warnings (job, id, code, message, blocking), excluded (job, position, title, reason), alternatives (job, speed, pauses, output,
    percent, state), hints (job, n, text) and bars (job, bar).
    """
    out = F.concat(span(F.col("out"), F.col("out") + F.col("length")), F.lit(" ("), half_up(F.col("length")).cast("long").cast("string"), F.lit(" s)"))
    shown = lines(cuts.where("included"), ["number"], table_row(F.col("number"), span(F.col("start"), F.col("end")), out, F.col("priority"), F.col("phrase")), "cut_lines")
    kept = lines(cuts.where("not included"), ["number"], table_row(F.col("number"), span(F.col("start"), F.col("end")), F.col("reason")), "reserve_lines")
    said = lines(warnings, [F.coalesce("id", F.lit(1 << 40)).alias("id"), "code"], warning_line(), "warning_lines")
    left = lines(excluded, ["position"], table_row(F.col("title"), F.col("reason")), "excluded_lines")
    speed = F.concat(F.lit("×"), comma(F.col("speed"), 2))
    tried = lines(alternatives, ["speed", (~F.col("pauses")).alias("without")], table_row(speed, F.when(F.col("pauses"), "sí").otherwise("no"), clock(F.col("output")), F.concat(comma(F.col("percent")), F.lit(" %")), F.col("state")), "tried_lines")
    hinted = lines(hints, ["n"], F.concat(F.lit("- "), "text"), "hint_lines")
    rows = report
    for part in (shown, kept, said, left, tried, hinted, bars):
        rows = rows.join(part, "job", "left")
    target = F.when(F.col("target").isNull(), "sin objetivo · ").otherwise(F.concat(F.lit("objetivo "), clock(F.col("target")), F.lit(" (banda "), span(F.col("low"), F.col("high")), F.lit(") · ")))
    first = F.concat(F.lit("Original "), clock(F.col("total")), F.lit(" · "), target, F.lit("estimación "), clock(F.col("output")), F.lit(" ("), comma(F.col("percent")), F.lit(" %) · estado **"), F.col("state"), F.lit("**"))
    way = F.concat(F.col("cuts").cast("string"), F.lit(" cortes · "), clock(F.col("source")), F.lit(" → sin pausas "), clock(F.col("after_pauses")), F.lit(" → "), speed, F.lit(" → "), clock(F.col("output")))
    none = F.when(F.col("state") == "ok", "- ninguna: el plan está dentro de la banda").otherwise(F.concat(F.lit("- ninguna aplicable: no hay ajuste disponible para el estado «"), "state", F.lit("».")))
    rows = rows.withColumn("hint_lines", F.coalesce("hint_lines", F.array(none)))
    scale = F.concat(F.lit("0:00 ← cada carácter son "), comma(F.col("total") / 60), F.lit(" s → "), clock(F.col("total")))
    text = _document(rows, [
        F.concat(F.lit("# Propuesta v"), F.col("version").cast("string"), F.lit(" · resumen de «"), F.col("name"), F.lit("»")), "", first, "", way,
        *section("Avisos"), ("warning_lines", ["- ninguno"]),
        *section("Cortes", "| # | Origen | Salida estimada | Prioridad | Qué se dice |", "| --- | --- | --- | --- | --- |"), ("cut_lines", []),
        *section("Reservas", "| # | Origen | Qué aportaría |", "| --- | --- | --- |"), ("reserve_lines", []),
        *section("Exclusiones deliberadas", "| Qué | Por qué |", "| --- | --- |"), ("excluded_lines", []),
        *section("Alternativas", "| Velocidad | Pausas | Salida | % | Estado |", "| --- | --- | --- | --- | --- |"), ("tried_lines", []),
        *section("Sugerencias"), ("hint_lines", []), *section("Recorrido"), F.concat(F.lit("`"), F.coalesce("bar", F.lit("·" * 60)), F.lit("`")), "", scale, *section("Cómo responder"), *ANSWERS, "",
    ])
    return rows.select("job", text.alias("text"))


def outline_document(heads: DataFrame, ideas: DataFrame, questions: DataFrame, warnings: DataFrame, excluded: DataFrame) -> DataFrame:
    """The outline of a recording without pictures: job, text. heads: job, version, name, total; ideas and questions: job, number, start, end and
    priority and phrase, or question and answer."""
    told = lines(ideas, ["number"], table_row(F.col("number"), span(F.col("start"), F.col("end")), F.col("priority"), F.col("phrase")), "idea_lines")
    asked = lines(questions, ["number"], table_row(F.col("number"), span(F.col("start"), F.col("end")), F.col("question"), F.col("answer")), "question_lines")
    said = lines(warnings, ["code"], warning_line(False), "warning_lines")
    left = lines(excluded, ["position"], table_row(F.col("title"), F.col("reason")), "excluded_lines")
    rows = heads
    for part in (told, asked, said, left):
        rows = rows.join(part, "job", "left")
    n = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))).cast("string")
    first = F.concat(F.lit("Original "), clock(F.col("total")), F.lit(" · "), n("idea_lines"), F.lit(" ideas · "), n("question_lines"), F.lit(" preguntas · sin montaje (entrada de solo audio)"))
    text = _document(rows, [
        F.concat(F.lit("# Esquema v"), F.col("version").cast("string"), F.lit(" · documento de «"), F.col("name"), F.lit("»")), "", first, "",
        "En modo audio se ignoran objetivo, velocidad y pausas: la entrega es el documento.", *section("Avisos"), ("warning_lines", ["- ninguno"]),
        *section("Ideas", "| # | Origen | Prioridad | Qué se dice |", "| --- | --- | --- | --- |"), ("idea_lines", []),
        *section("Preguntas", "| # | Origen | Pregunta | Respuesta |", "| --- | --- | --- | --- |"), ("question_lines", ["| — | — | No se registraron preguntas en la sesión. | — |"]),
        *section("Exclusiones deliberadas", "| Qué | Por qué |", "| --- | --- |"), ("excluded_lines", []), *section("Cómo responder"), *OUTLINE_ANSWERS, "",
    ])
    return rows.select("job", text.alias("text"))


def data_sheet(rows: DataFrame, today: Column | None = None) -> DataFrame:
    """A montage's data sheet: rows (job, name, total, output, cuts, pauses, speed, transcriber, version) -> job, text."""
    day = F.date_format(F.current_date() if today is None else today, "yyyy-MM-dd")
    techniques = F.concat(counted(F.col("cuts"), "corte", "cortes"), F.lit(" · "), F.when(F.col("pauses"), "pausas eliminadas").otherwise("pausas conservadas"), F.lit(" · velocidad "), factor(F.col("speed")))
    fields = [
        ("Archivo", F.col("name")), ("Duración original", clock(F.col("total"))),
        ("Duración del resumen", F.concat(clock(F.col("output")), F.lit(" ("), percent(F.col("output"), F.col("total")), F.lit(" del original)"))), ("Técnicas", techniques),
        ("Transcripción", F.col("transcriber")), ("Versión", F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(" · "), day)),
    ]
    body = [table_row(F.lit(title), value) for title, value in fields]
    return rows.select("job", F.concat_ws("\n", F.lit("| Campo | Valor |"), F.lit("| --- | --- |"), *body).alias("text"))


def transcriber(model: Column, origin: Column, language: Column, there: Column) -> Column:
    """How the words were got."""
    name = F.coalesce(F.nullif(model, F.lit("")), F.nullif(origin, F.lit("")), F.lit("subtítulos del medio"))
    said = F.concat(name, F.lit(" ("), F.coalesce(F.nullif(language, F.lit("")), F.lit("idioma sin declarar")), F.lit(")"))
    return F.when(there, said).otherwise("sin transcripción")


def validation_table(rows: DataFrame) -> DataFrame:
    """The results of a montage's checks: rows (job, frames, expected, drift, places, image, lag, marks, joins) -> job, text."""
    three = lambda c: F.translate(F.format_string("%.3f", half_up(F.col(c), 3)), ".", ",")
    placed = F.concat(counted(F.col("places"), "corte comprobado", "cortes comprobados"), F.lit(" · imagen máx. "), three("image"), F.lit(" · envolvente máx. "), half_up(F.col("lag")).cast("long").cast("string"), F.lit(" ms"))
    fields = [
        ("Fotogramas", F.concat(F.coalesce(F.col("frames").cast("string"), F.lit("?")), F.lit(" de "), F.coalesce(F.col("expected").cast("string"), F.lit("?")), F.lit(" esperados"))),
        ("Desfase vídeo/audio", F.concat(three("drift"), F.lit(" s"))), ("Colocación de los cortes", placed), ("Ventanas marcadas", counted(F.col("marks"), "ventana", "ventanas")), ("Hojas de uniones", counted(F.col("joins"), "unión", "uniones")),
    ]
    body = [table_row(F.lit(title), value) for title, value in fields]
    return rows.select("job", F.concat_ws("\n", F.lit("| Comprobación | Resultado |"), F.lit("| --- | --- |"), *body).alias("text"))
