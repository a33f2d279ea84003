import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tesela.functions import structure as st

LAW = "LEY N° 10.000\n\nVisto lo actuado.\n\nTÍTULO I\nDISPOSICIONES GENERALES\nARTÍCULO 1°.- Objeto de la norma.\na) uno\nb) dos\n\nARTÍCULO 2°.- Alcance de la norma.\n\nTÍTULO II\nARTÍCULO 3°.- Final.\n\nANEXO I\nPlanilla"


def test_broken_words_join_and_offsets_lead_back():
    text = "datos perso-\nnales y\nmás datos.\n\nOtro párrafo"
    body, index = st.clean(text)
    assert body == "datos personales y más datos.\n\nOtro párrafo"
    for i, c in enumerate(body):
        assert text[index[i]] == c or (c == " " and text[index[i]] == "\n")
    assert st.original_offset(index, len(body), len(text)) == len(text)


def test_breaks_beside_structural_lines_stay():
    assert st.clean("ANEXO I\nPlanilla")[0] == "ANEXO I\nPlanilla"
    assert st.clean("texto corrido\nARTÍCULO 5 sigue")[0] == "texto corrido\nARTÍCULO 5 sigue"
    assert st.clean("a - b\nc")[0] == "a - b c"


def test_boundaries_take_the_most_specific_kind():
    text = "# Título\n\n1. uno\na) inciso\n- lista\nOBJETO GENERAL:\n\fpágina"
    kinds = {text[b[0] :].split("\n")[0]: b[2] for b in st.boundaries(text)}
    assert kinds["# Título"] == "heading" and kinds["1. uno"] == "numbered" and kinds["a) inciso"] == "item"
    assert kinds["- lista"] == "list" and kinds["página"] == "page"
    assert [b[2] for b in st.boundaries("uno\n\ndos", {"paragraph"})] == ["paragraph", "paragraph"]
    assert st.boundaries("") == []


def test_outline_and_paths():
    nodes = st.outline(LAW)
    assert [n[3] for n in nodes][:4] == ["LEY 10.000", "TITULO I", "SECCION", "ARTICULO 1"]
    assert st.path_at(nodes, LAW.index("Alcance")) == "LEY 10.000 > TITULO I > SECCION > ARTICULO 2"
    assert st.path_at(nodes, LAW.index("Final")) == "LEY 10.000 > TITULO II > ARTICULO 3"
    assert st.path_at(nodes, -1) == "" and st.path_at([], 5) == ""


def test_articles_take_their_headings_and_the_preamble_stays_alone():
    pieces = [p.text for p in st.article_pieces(LAW)]
    assert pieces[0].endswith("Visto lo actuado.") and pieces[1].startswith("TÍTULO I\nDISPOSICIONES")
    assert pieces[2].startswith("ARTÍCULO 2°") and pieces[3].startswith("TÍTULO II\nARTÍCULO 3°") and pieces[4] == "ANEXO I\nPlanilla"
    assert st.article_pieces("sin articulado") is None


def test_long_articles_are_cut_within_the_limit():
    text = "ARTÍCULO 1°.- " + "Frase de prueba con palabras. " * 60
    pieces = st.article_pieces(text, 200)
    assert len(pieces) > 5 and all(len(p.text) <= 200 for p in pieces)


def test_table_of_contents_of_pages_is_no_boundary():
    toc = "\n".join(f"ARTÍCULO {i} .......... {i}" for i in range(1, 6))
    text = toc + "\nCuerpo.\nARTÍCULO 1.- Texto.\nARTÍCULO 2.- Texto."
    assert len(st.article_pieces(text, pdf=True)) == 3 and len(st.article_pieces(text)) > 5


def test_page_fragments_drop_footers_and_contents():
    text = "1. Índice\n2. Objeto\n3. Alcance\n-- 1 of 3 --\nARTÍCULO 1\nTexto del artículo que alcanza.\n2. La recolección de datos sigue aquí."
    parts = st.page_fragments(text)
    assert not any("of 3" in p for p in parts) and any("recolección" in p for p in parts) and not any(p.startswith("1. Índice") for p in parts)


def test_paragraphs_of_plain_text():
    assert st.block_paragraphs("corto\n\n# título que es largo de verdad\n\neste párrafo sí es bastante largo") == ["este párrafo sí es bastante largo"]


def test_short_pieces_go_with_the_next():
    merged = st.merged_short([st.Span("ART. 1", 0, 6), st.Span("cuerpo largo", 7, 19), st.Span("x", 20, 21)], 8)
    assert [m.text for m in merged] == ["ART. 1 cuerpo largo", "x"]


def test_hierarchy_counts_children_inside_parents():
    split, _ = st.split_document(LAW * 5, st.LEGAL, overlap=20)
    for p in split.parents:
        assert all(c.parent == p.index for c in split.children[p.first_child : p.last_child + 1])
    assert [c.index for c in split.children] == list(range(len(split.children)))
    assert split.children[1].extended.endswith(split.children[1].text[-6:]) and split.children[1].path


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(["ARTÍCULO 1.- ", "a) ", "\n", "\n\n", "palabra ", "Frase. ", "TÍTULO I\n", "x" * 40, " - ", "perso-\nnales"]), max_size=60))
def test_no_text_is_lost(parts):
    text = "".join(parts)
    bare = lambda t: re.sub(r"[\s-]+", "", t)
    for s in (st.GENERIC, st.Strategy("legal", 120, 60, 10, True, True)):
        split, _ = st.split_document(text, s)
        assert bare("".join(c.text for c in split.children)) == bare(text)


@pytest.mark.parametrize("limit", [5, 17, 100])
def test_long_pieces_keep_the_limit_and_the_text(limit):
    text = "Una frase. Otra, más larga; y otra\nlínea " * 7
    pieces = st.long_pieces(text, limit)
    assert all(len(p.text) <= limit for p in pieces) and re.sub(r"\s", "", "".join(p.text for p in pieces)) == re.sub(r"\s", "", text)


# --- expected rows, written by hand from the described behaviour ---------------------------------------------------------------

NORM = "\n".join(
    [
        "LEY 27.541 - PRESUPUESTO.", "CONSIDERANDO que resulta necesario adecuar el marco fiscal.", "TITULO II - REGIMEN FISCAL.", "ARTICULO 1. - Objeto de la presente.",
        "ARTICULO 2. - Facultades de la autoridad.", "TITULO III - DISPOSICIONES FINALES.", "ARTICULO 3. - Vigencia.", "ANEXO I", "Formulario de declaración jurada.",
    ]
)


def test_articles_of_a_norm_row_by_row():
    lines = NORM.split("\n")
    assert [(p.start, p.text) for p in st.article_pieces(NORM)] == [
        (0, "\n".join(lines[:2])), (NORM.index("TITULO II "), "\n".join(lines[2:4])), (NORM.index("ARTICULO 2"), lines[4]),
        (NORM.index("TITULO III"), "\n".join(lines[5:7])), (NORM.index("ANEXO"), "\n".join(lines[7:])),
    ]


@pytest.mark.parametrize(
    "text, starts",
    [
        ("TITULO II - FISCAL.\nCAPITULO III - IMPOSICION.\nARTICULO 14. - Uno.\nARTICULO 15. - Dos.", ["TITULO II", "ARTICULO 15"]),
        ("ARTICULO 4. - Regla.\n\nTITULO V - PLAZOS.\nEl plazo corre.\n\nARTICULO 20. - Plazo.", ["ARTICULO 4", "TITULO V"]),
        ("TITULO V - PLAZOS.\nEl plazo corre.\n\nARTICULO 20. - Plazo.", ["TITULO V", "ARTICULO 20"]),
        ("ARTICULO 1. - Uno.\nTITULO I - A.\nTexto.\nTITULO II - B.\nARTICULO 2. - Dos.", ["ARTICULO 1", "TITULO II"]),
        ("ANEXO A\nTabla.\nANEXO B\nOtra.", ["ANEXO A", "ANEXO B"]),
        ("ARTICULO 1. - Uno.\nTITULO I - A.\nANEXO B\nOtra.", ["ARTICULO 1", "ANEXO B"]),
    ],
)
def test_headings_go_with_the_article_below(text, starts):
    pieces = st.article_pieces(text)
    assert len(pieces) == len(starts) and all(p.text.startswith(s) for p, s in zip(pieces, starts))


def test_contents_of_pages_row_by_row():
    toc = ["LEY 27.541 - X.", "TITULO II .......... 5", "CAPITULO III ....... 6", "ARTICULO 14 ........ 7", "ARTICULO 15 ........ 8"]
    text = "\n".join([*toc, "TITULO II - FISCAL.", "ARTICULO 14. - Uno.", "ARTICULO 15. - Dos."])
    assert [p.text for p in st.article_pieces(text, pdf=True)] == ["\n".join(toc), "TITULO II - FISCAL.\nARTICULO 14. - Uno.", "ARTICULO 15. - Dos."]
    short = "\n".join(["ARTICULO 1 ... 3", "ARTICULO 2 ... 4", "ARTICULO 3 ... 5", "ARTICULO 1. - Uno."])
    assert st.contents_lines(short, st.outline(short)) == set()


def test_structural_pieces_row_by_row():
    text = "# Título\n\nARTÍCULO 1. Inicio.\n\nARTÍCULO 2. Siguiente."
    assert [(p.text, text[p.start : p.end]) for p in st.structural_pieces(text, 2000)] == [(x, x) for x in text.split("\n\n")]
    words = "UNO" * 50
    assert [p.text for p in st.structural_pieces(words, 100)] == [words[:100], words[100:]]
    soft = "Primero de todos.\n\nSegundo bloque.\n\nTercero."
    assert [p.text for p in st.structural_pieces(soft, 35)] == ["Primero de todos.\n\nSegundo bloque.", "Tercero."]
    assert [p.text for p in st.structural_pieces("OBJETO GENERAL:\nuna frase. otra frase. y otra más", 24)] == ["OBJETO GENERAL:", "una frase. otra frase.", "y otra más"]
    assert len(st.structural_pieces(soft, 35, size_for=lambda s: 8)) > 3


def test_blocks_and_long_pieces_row_by_row():
    assert [p.text for p in st.grouped(["uno", "dos", "tres"], 8)] == ["uno\n\ndos", "tres"]
    assert [p.text for p in st.grouped(["uno", "x" * 12, "dos"], 8)] == ["uno", "x" * 8, "x" * 4, "dos"]
    assert [p.text for p in st.long_pieces("una línea\notra línea más", 15)] == ["una línea", "otra línea más"]
    assert [p.text for p in st.long_pieces("Fin. Otra cosa", 9)] == ["Fin.", "Otra", "cosa"]


def test_cleaned_text_and_its_map_row_by_row():
    body, index = st.clean("A.\nB\n\nC.")
    assert body == "A. B\n\nC." and [index[i] for i in (2, 3, 6)] == [2, 3, 6]
    assert st.clean("perso-\nnales")[0] == "personales" and st.clean("personales\nasentados")[0] == "personales asentados"
    kept = "ARTICULO 1. - Cuerpo.\na) inciso primero.\nb) inciso segundo."
    assert st.clean(kept)[0] == kept


def test_parents_and_children_row_by_row():
    split, _ = st.split_document(NORM, st.LEGAL, overlap=10)
    assert [p.text.split(" ")[0] for p in split.parents] == ["LEY", "TITULO", "ARTICULO", "TITULO", "ANEXO"]
    assert [(p.first_child, p.last_child) for p in split.parents] == [(i, i) for i in range(5)]
    assert split.children[2].path == "LEY 27.541 > TITULO II > ARTICULO 2" and split.children[2].extended.endswith(split.children[2].text)
    plain, index = st.split_document(NORM, st.GENERIC)
    assert index is None and all(c.path is None and c.extended is None for c in plain.children)
    assert (st.GENERIC.parent_max, st.GENERIC.child_max, st.GENERIC.child_min) == (2500, 1000, 150)
    assert (st.LEGAL.parent_max, st.LEGAL.child_max, st.LEGAL.child_min) == (3500, 1200, 150)


def test_page_fragments_row_by_row():
    text = "1. Índice\n2. Objeto\n-- 1 of 3 --\n\nARTÍCULO 1\nTexto del artículo que alcanza.\n2. La recolección de datos."
    assert st.page_fragments(text) == ["2. Objeto\nARTÍCULO 1\nTexto del artículo que alcanza.", "2. La recolección de datos."]
