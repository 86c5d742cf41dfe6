"""The cleaning rules, a case or more for each, and their native forms on all documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import latex as tex
from palimpsest.operators import latex
from tests.conftest import DATA

#: Rule, LaTeX, and what is left of it; written by hand from the rules' descriptions.
CASES = [
    ("C1", r"caf\'e na{\"i}ve \^o \~n", "cafe naive o n"),
    ("C2", r"a \begin{abstract}x y\end{abstract} b \begin{frontmatter}q\end{frontmatter} c \title[s]{T {n} u} d \author*{A} e", "a b c d e"),
    ("C3", r"a \ensuremath{x_{1}} b \lstinputlisting[l]{f.py} c \verbatiminput{f} d \ensuremathx{y} e", "a MATH b CODE c CODE d y e"),
    ("C4", r"a $$x = 1$$ b \[ y \] c", "a EQN b EQN c"),
    ("C5", r"a \( x + y \) b", "a MATH b"),
    ("C6", r"$x$ and $3$ and $10 D$ and $\mathcal{N}$ and $\bf v$ and ${\cal N}=4$ and $k = -2$ and $x+y$ cost $5", "x and 3 and 10d and n and v and n = 4 and k = 2 and MATH cost $5"),
    ("C7", "a \"b\" 'c' `d`", "a b c d"),
    ("C8", "a~b~~c", "a b c"),
    ("C9", r"a \begin{align*} x \end{align*} b \begin{equation}[o] y \end{equation} c \begin{gather} z and the rest", "a EQN b EQN c EQN"),
    ("C10", r"a \begin{empheq}[box]{align} x \end{empheq} b", "a EQN b"),
    ("C11", r"a \begin{figure}[ht] x \end{figure} b \begin{tabular}{cc} 1 & 2 \end{tabular} c", "a FIG b FIG c"),
    ("C12", r"a \xymatrix x \endxymatrix b", "a FIG b"),
    ("C13", r"a \begin{verbatim} x \end{verbatim} b", "a CODE b"),
    ("C14", r"a \begin{algorithm} x \end{algorithm} b", "a ALG b"),
    ("C15", r"a \begin{python} x \end{python} b \begin{c++} y \end{c++} c", "a CODE b y c"),
    ("C16", r"a \begin{minipage}{3cm} b", "a b"),
    ("C17", r"a \be x \ee b \beq y \eeq c \beta d \eeta e", "a EQN b EQN c d e"),
    ("C18", r"a \makeatletter x@y \makeatother b", "a b"),
    ("C19", r"a \label{eq:1}b \labelx{q} c", "a b c"),
    ("C20", r"a \includegraphics*[w=1]{f{g}h} b", "a FIG b"),
    ("C21", r"a \ref{x} b \Cref{y} c \eqref{z} d", "a REF b REF c REF d"),
    ("C22", r"a \cite[p.~3][q]{x}{y} b \Citep*{z} c \nocite{n} d", "a CITE b CITE c CITE d"),
    ("C23", r"a \url{h} b \href{u}{t} c \hyperlink{u}{t} d \hyperref[l] e", "a URL b URL c URL d URL e"),
    ("C24", r"a \item[one] b", "a b"),
    ("C25", r"a \addcontentsline{t}{s}{u} b \pdfbookmark[1]{x}{y} c \printbibliography [o] d", "a b c d"),
    ("C26", r"a \phantomsection b", "a b"),
    ("C27", r"a \setcounter{c}{3} b \addtocounter{c}{1} c", "a b c"),
    ("C28", r"a \section{Intro} b \section{Acknowledgments} no \subsection{More} no \section{Next} c \subsection*{References} no", "a b c"),
    ("C29", r"a \section[s]{T {u} v} b \subsubsection*{W} c \part{P} d", "a b c d"),
    ("C30", r"a \footnote[1]{some words} b", "a some words b"),
    ("C31", r"a \textbf{bold} \emph{it} \mbox{box} b \textit{x {y} z}", "a bold it box b x y z"),
    ("C32", r"a \verb|x y| b \lstinline!q! c \mintinline{py}|z| d", "a CODE b CODE c py|z| d"),
    ("C33", r"a \begin{center}[o] b \end{center} c", "a b c"),
    ("C34", r"a\\[2pt]b\par c\newline d\ e\bigskip f", "a b c d e f"),
    ("C35", r"a \vspace*{1cm} b \hspace{a{b}} c", "a b c"),
    ("C36", r"hy\-phen", "hyphen"),
    ("C37", r"a \tikzstyle{n}=[draw [x]] b \tikzstyle{m}+=[y] c", "a b c"),
    ("C38", r"a \tikzset{x={y}} b \hypersetup{c} d \acknowledgments{e} f", "a b d f"),
    ("C39", r"a \% b \& c \# d \_ e \; f", "a b c d e f"),
    ("C40", r"a \special{x} b \pgfsys@literal{y} c", "a FIG b FIG c"),
    ("C41", r"a \setlength{x}{1pt} b \newtheorem{t}{T} c", "a b c"),
    ("C42", r"a \itemsep -3.5 pt b \topsep0em c", "a b c"),
    ("C43", r"a \titleformat[x][y] b", "a b"),
    ("C44", r"a \setkomafont[x]{y} b", "a b"),
    ("C45", r"a \parindent = 0 b \parskip=2.5 mm c", "a b.5 mm c"),
    ("C46", r"a \rotatebox[o]{90} b", "a b"),
    ("C47", r"a \setcounter{page}{1} b", "a b"),
    ("C48", r"a \textcolor{red}{b} c", "a b c"),
    ("C49", r"a \1 b \foo* c \bar d \" e", "a b c d e"),
    ("C50", "a [ ] b [] c", "a b c"),
    ("C51", "a {b} c", "a b c"),
    ("C52", "see Smith:2021abc and *Lee:1999 now", "see CITE now"),
    ("C53", "a 1/2a b x1/y2.z c x/y d", "a NUM b NUM c x/y d"),
    ("C54", "a 12 b 11 c 26 d N4 e SU26 f 3d g abcd5 h 3.14 i v1.2.x j 10 k 27", "a NUM b 11 c 26 d n4 e su26 f 3d g NUM h NUM i NUM j 10 k NUM"),
    ("C54 before a dot", "there are 2. Then", "there are NUM. then"),
    ("C55", "a–b c−d", "a-b c-d"),
    ("C56", "wait... no!! a--b x::y", "wait. no! a-b x:y"),
    ("C57", "a=b c  =  d", "a = b c = d"),
    ("C58", "a, , b ,. c", "a, b. c"),
    ("C59", "a- b -c d-e", "a b c d-e"),
    ("C60 brackets", r"as ( \cite{a} ) says", "as CITE says"),
    ("C60 lists", r"by \cite{a}, \cite{b} and \cite{c} or $x+y$", "by CITE"),
    ("C60 priority", r"in \ref{a} \begin{figure} x \end{figure} $a+b$ \begin{equation} y \end{equation} now", "in EQN now"),
    ("C60 numbers", "from 12, 13 and 14 on", "from NUM on"),
    ("C61", r"x\cite{a}y \ref{b}(c)", "x CITE y REF (c)"),
    ("C62", "a ( b ) , c [ d ] .", "a (b), c [d]."),
    ("C63", "a \n\t  b", "a b"),
    ("C64", r"ABC \cite{X} Def", "abc CITE def"),
    ("C65", "  Straße Æsir ﬁne Ω  ", "strasse aesir fine "),
]


@pytest.mark.parametrize(("rule", "body", "expected"), CASES, ids=[c[0] for c in CASES])
def test_rule(rule, body, expected):
    assert tex.cleaned(body) == expected


def test_every_rule_has_a_case():
    assert {int(c[0].split()[0][1:]) for c in CASES} == set(range(1, 66))


def test_long_argument():
    """A braced argument of 200,000 characters, and one that never closes."""
    assert tex.cleaned(r"a \section{" + "x {y} " * 40_000 + "} b") == "a b"
    assert tex.cleaned(r"a \section{" + "x " * 1000).startswith("a x x")


def test_native_forms(spark):
    """The columns of built-in functions give what the plain functions do, on all documents and on made-up texts."""
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += ["a 12 11. 26 N4 SU27 3.14.x v1.2 x.5y.7 abcd5 10a 2", "( @@math@@ ), @@eqn@@ and @@ref@@ - @@num@@; @@url@@ @@cite@@ [ @@fig@@ ] @@alg@@ or @@code@@", "", "@@num@@, @@num@@ and @@cite@@!"]
    made = [f"( @@math@@ ) {t[:200]} @@ref@@ @@num@@ and @@eqn@@, {t[200:300]}" for t in texts]
    df = spark.createDataFrame(list(zip(texts, made, strict=True)), "text string, made string")
    for row in df.select("text", "made", latex.mask_numbers(F.col("text")).alias("masked"), latex.merge_placeholders(F.col("made")).alias("merged")).collect():
        assert row.masked == tex.numbers_masked(row.text) and row.merged == tex.ladder(row.made)
