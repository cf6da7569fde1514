"""What the languages permit: pairs of adjacent kinds, and productions of the content of every group.

A group is what stands between two brackets or two levels of indentation, with every group inside it reduced to one letter:
P parentheses, B square brackets, C braces, S an indented block. So no production is recursive. `roles` says, from the
bracket and the kind before it, which productions a group may follow; it is admissible if it follows one of them. All
patterns run in Python's `re`, whose matching takes no stack, with possessive repetition of statements: time in proportion.

Notation of the productions: words are reserved words, operators stand in quotes, single letters are kinds and groups (see
`lexer`), $name is another production; the rest is the notation of `re` with blanks left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

from topolane.llm.lexer import BLOCK, CHAR, CHARS, CODE, DIRECTIVE, END, IDENT, KEYWORDS, LIFETIME, LINE, NUMBER, OPERATORS, REGEX, SOFT, START, STRING

def permitted(lang: str) -> set[str]:
    """Pairs of kinds that may stand beside each other, built from the roles that the grammar gives each kind."""
    words, ops = KEYWORDS[lang].split(), OPERATORS[lang].split()
    kinds = {IDENT, NUMBER, STRING, START, END, *"()[]{}", *(CODE[w] for w in words + ops)}
    js = lang in ("javascript", "typescript")
    if lang in CHARS:
        kinds.add(CHAR)
    if lang == "rust":
        kinds.add(LIFETIME)
    if js:
        kinds.add(REGEX)
    soft = {CODE[x] for x in SOFT[lang]} if js else set()
    if js or lang in ("go", "python"):
        kinds.add(LINE)
    if lang == "python":
        kinds |= {">", "<"}
    if lang == "c":
        kinds.add(DIRECTIVE)
    code = lambda *x: {CODE[y] for y in x if y in words or y in ops}
    literal = {NUMBER, STRING, CHAR, REGEX} & kinds
    constants = code("True", "False", "None", "true", "false", "null", "this", "self", "Self", "super", "crate")
    types = code("boolean", "byte", "char", "double", "float", "int", "long", "short", "void", "signed", "unsigned", "_Bool", "chan", "map", "struct", "interface", "union", "enum", "func", "const", "volatile", "static", "restrict", "type")
    ends = literal | {IDENT, ")", "]", "}"} | constants | code("++", "--", "?", "...", "_Bool", "break", "continue", "return", "pass", "fallthrough", "class", "yield", "await", "default", "super", "async", "let", "var", "function")
    ends |= soft
    ends |= types & code("int", "char", "void", "long", "short", "double", "float", "boolean", "byte", "unsigned", "signed", "interface")
    prefix = code("+", "-", "*", "&", "!", "~", "++", "--", "<-", "^", "@", "#", "...", "..", "..=", "&&", "||", "|", "<", "::", "?", "**")
    out: set[str] = set()
    binary = code(*[o for o in ops if o not in ("!", "~", "++", "--", "@", "#", "$", ";", ",", ":", "?", "...", "::", "<-")])
    closers, separators = {")", "]", "}"}, code(",", ";", ":") | ({LINE} & kinds)
    word_kinds = {CODE[w] for w in words}
    #: Words that may follow a literal.
    infix = code("if", "else", "and", "or", "not", "in", "is", "for", "async", "from", "as", "instanceof", "of", "satisfies", "with", "extends", "import", "while", "throws", "fn") | (soft if js else set())
    for a in kinds:
        for b in kinds:
            ok = True
            if a == START:
                ok = b not in closers and b not in binary - prefix and b not in ({NUMBER} if lang in ("rust", "go", "java", "c") else set())
            elif b == END:
                ok = a not in {"(", "[", "{"} and a not in code(",", ".", "=", "=>", "->", "::", "+=", "-=", "&&", "||", "==", "!=", "@", "#", ":=", "?.", "===", "!==") and (a not in word_kinds or a in ends)
            elif a in ends and a not in {"}"} and b in (literal | {IDENT} | constants) and a not in types:
                # Two operands side by side.
                ok = (a, b) == (STRING, STRING) and lang in ("python", "c")
                if a in soft:
                    ok = True
                if b == IDENT:
                    typed = {"rust": {")", "]", CODE["crate"]}, "go": {IDENT, ")", "]"}, "java": {IDENT, "]", ")"}, "c": {IDENT, ")"}, "typescript": {")"}, "javascript": {")"}, "python": set()}[lang]
                    ok = ok or a in typed or a in code("...", "default", "async", "await", "yield", "?", "let", "var", "function", "class", "return", "break", "continue", "++", "--", "super")
                elif a in code("return", "yield", "await", "break", "default", "++", "--", "?", "...", "async", "class", "super"):
                    ok = True
                elif a == ")" and lang in ("java", "c", "go"):
                    ok = True  # a cast
                elif a == IDENT and b in (literal | constants):
                    ok = (lang == "go" and b == STRING) or (lang == "c" and b == STRING) or (lang == "java" and b in code("this", "super")) 
                elif a == ")" and js:
                    ok = True  # the statement of an if or while
                elif a == "]" and lang in ("go",):
                    ok = True
            elif a in binary - ends and b in closers:
                ok = (lang in ("c", "go", "rust", "java") and a in code("*", "&", "..", ">", "->", "/", ">>")) or (lang == "python" and a in code("*", "/")) or (js and a in code(">", "*"))
                ok = ok or a in code(">", ">>", ">>>")
            elif a in binary - ends and b in separators:
                ok = a in code(">", ">>", ">>>", "..", "*", "/", "&", "|", "-", "<") if lang != "python" else a in code("*", "/", "...")
                if lang in ("go", "javascript", "typescript", "python") and b == LINE:
                    ok = a in code(">", "*", ">>")
            elif a in binary - ends and b in binary - prefix:
                # The end of type arguments looks like a comparison.
                ok = lang in ("rust", "java", "typescript") and a in code(">", ">>", ">>>") and b in code("=", "=>", "->", ">", "|", "&", ".", "?.")
                ok = ok or (lang == "java" and a in code("<") and b in code(">")) or (lang == "python" and a in code(".", "...") and b in code(".", "..."))
                ok = ok or (lang == "c" and a in code("*") and b in code(".")) or (lang == "rust" and a in code("|", "||") and b in code("->"))
            elif a == CODE[","] and b in binary - prefix:
                ok = (lang == "python" and b in code("/", "=")) or (lang == "c" and b in code("."))
            elif a == CODE[","] and b == CODE[","]:
                ok = js
            elif a in {"(", "["} and b in binary - prefix:
                ok = (lang == "python" and b in code("/")) or (lang == "rust" and b in code("..=")) or (lang == "java" and b == CODE.get(">"))
            elif a in {"(", "["} and b == CODE[","]:
                ok = js and a == "["
            elif a in {"(", "["} and b == CODE[";"]:
                ok = a == "("
            elif a in word_kinds and b == NUMBER and a in code("class", "def", "fn", "struct", "enum", "trait", "func", "package", "import", "interface", "function", "use", "mod", "type", "let", "const", "var"):
                ok = False
            if a == CODE[","] and b == CODE.get(">") and lang in ("rust", "typescript"):
                ok = True
            if lang == "rust" and (a == "]" and b in literal | constants or a in code(">>", ">") and b in code(">>", ">") or (a, b) == (CODE["let"], CODE["Self"])):
                ok = True
            if js and a == STRING and b == IDENT:
                ok = False
            if a in literal | code("True", "False", "None", "true", "false", "null") and b in word_kinds - infix:
                ok = False
            if lang == "go" and a == LINE and b in binary - prefix - code(".",):
                ok = False
            if ok:
                out.add(a + b)
    return out

_TOKEN = re.compile(r"'([^'\s]+)'|([A-Za-z_]{2,})|(\\.)|\s+|(.)")
_NAME = re.compile(r"\$(\w+)")


def _text(rules: dict[str, str], name: str) -> str:
    text = rules[name]
    while _NAME.search(text):
        # Lists of kinds stand inside brackets, all else is a group.
        text = _NAME.sub(lambda m: f"(?:{r})" if "(" in (r := rules[m[1]]) else r, text)
    return text


def _compile(rules: dict[str, str], name: str) -> re.Pattern:
    def put(m: re.Match) -> str:
        if m[1] or m[2]:
            return re.escape(CODE[m[1] or m[2]])
        return m[3] or m[4] or ""

    return re.compile(_TOKEN.sub(put, _text(rules, name)))


_ASSIGNS = "'=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>='"

JAVA = {
    "prim": "boolean byte char double float int long short void",
    "W": "if else for while do try catch finally return throw break continue case default import package goto const assert public private protected static abstract native strictfp transient volatile enum interface throws implements synchronized",
    "O": "i n s c new this true false null",
    "ann": "(?: '@' (?! interface ) i (?: '.' i )* P? )",
    "mod": "(?: $ann | public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default )",
    "gen": "(?: '<' [i ',' '.' '?' '&' '<' extends super B '@' P $prim '>' '>>' '>>>']* [ '>' '>>' '>>>' ] )",
    "type": "(?: $ann* [i $prim] $gen? (?: '.' $ann* i $gen? )* (?: $ann* B )* '...'? )",
    "y": "(?: [^ C P ';' ',' $W] | C (?! [$O] ) | (?<! [i P B C s] ) P | P (?! [$O] ) )",
    "x": "(?: $y )+",
    "decl": "(?: (?: final | $ann )* $type i B* (?: '=' $x )? (?: ',' i B* (?: '=' $x )? )* ';' )",
    "act": f"(?: (?= [^ ';']*? [P C '++' '--' '>>>=' {_ASSIGNS}] ) $x ';' )",
    "else": "else",
    "if": "if P",
    "pre": "(?: (?: for | while ) P | i ':' )",
    "catches": "(?: (?: catch P C )++ (?: finally C )? | finally C )",
    "inherit": "(?: [extends implements i ',' '.' '&' B] | $ann | $gen )*",
    "cls": "(?: (?: i '-' i | i )?? (?: class | interface | enum | '@' interface ) i $gen? $inherit C | i i $gen? P (?: implements $inherit )? C )",
    "simple": "(?: ';' | C | return $x? ';' | throw $x ';' | (?: break | continue ) i? ';' | assert $x ';' | do $pre* (?: if P )* (?: C | ';' | $x ';' | (?: break | continue | return ) $x? ';' ) while P ';'"
    " | try (?: P C $catches? | C $catches ) | switch P C (?! ['.' ';'] ) | synchronized P C | $mod* $cls | $decl | $act )",
    "label": "(?: case [^ ':' '->' ';' C]+ (?: '->' [^ ':' '->' ';' C]+ )?? ':' | default ':' )",
    "arrow": "(?: (?: case [^ ':' '->' ';' C]+ | default ) '->' (?: C | throw $x ';' | $x ';' ) )",
    "member": "(?: ';' | static? C | $mod* $cls | $mod* (?: $gen? $type i P B* (?: throws [i ',' '.']+ )? (?: C | (?: default $x )? ';' ) | $gen? i (?: P (?: throws [i ',' '.']+ )? )? C | $type i B* (?: '=' $x )? (?: ',' i B* (?: '=' $x )? )* ';' ) )",
    "members": "(?: $member )*+",
    "const1": "(?: $ann* i P? C? )",
    "enum": "(?: $const1 (?: ',' $const1 )* ','? )? (?: ';' $members )?",
    "array": "(?: $x (?: ',' $x )*+ )? ','?",
    "module": "(?: i [^ ';' C]+ ';' )*+",
    "for": "[^ ';']* ';' [^ ';']* ';' [^ ';']* | (?: final | $ann )* $type i ':' $x",
    "resources": "[^ ';']+ (?: ';' [^ ';']+ )*+ ';'?",
    "caught": "(?: final | $ann )* i [i '.' '|']* i",
    "cond": "$x",
    "list": "(?: (?: final | $ann )* $x (?: ',' (?: final | $ann )* $x )*+ )?",
    "index": "(?: $x )?",
    "top": "(?: $ann* package i (?: '.' i )* ';' )? (?: ';' | import static? i (?: '.' i )* (?: '.' '*' )? ';' )*+ (?: ';' | $mod* $cls | i? i (?: '.' i )* C )*+",
}

C = {
    "spec": "static extern inline const volatile register restrict signed unsigned short long int char void float double _Bool auto struct union enum typedef i",
    "W": "if else for while do switch case default break continue return goto",
    "O": "n s c",
    "y": "(?: [^ C ';' ',' d $W] | C (?! [i $O] ) )",
    "x": "(?: $y )+",
    "xs": "(?: $y | ',' )+",
    "else": "else",
    "if": "if P",
    "pre": "(?: (?: for | while | switch ) P | (?: i | case [^ ';' ':' C]+ (?: '?' [^ ';' C]+ )? | default ) ':' )",
    "simple": "(?: ';' | C ';'?? | return $xs? ';' | (?: break | continue ) ';' | goto [i '*' P]+ ';' | do $pre* (?: if P )* (?: C | ';' | return? $xs ';' | (?: break | continue ) ';' ) while P ';' | i P C | (?! C ) $xs ';' )",
    "def": "(?: (?= [^ ';' '=' C]* P ) [$spec '*' ',' B P]+ (?: [$spec '*' ',' B P]+ ';' )* C )",
    "top": "(?: ';' | extern s C | $def | i P (?= [$spec] | \\Z | ';' ) | (?= [$spec] ) (?! i ['=' ':'] ) (?: [$spec '*' ',' ':' P B C n] | '=' $x )+ ';' )*+",
    "fields": "(?: ';' | (?= [$spec] ) [^ ';' '=' $W]+ ';' )*+",
    "enum": "i (?: '=' $x )? (?: ',' i (?: '=' $x )? )*+ ','?",
    "init": "(?: $x (?: ',' $x )*+ )? ','?",
    "for": "[^ ';']* ';' [^ ';']* ';' [^ ';']*",
    "cond": "$xs",
    "list": "(?: $x (?: ',' $x )*+ )?",
    "index": "(?: static | const | restrict | volatile )* (?: $x )?",
}


def _ecma(ts: bool) -> dict[str, str]:
    lang = "typescript" if ts else "javascript"
    soft = " ".join(SOFT[lang])
    words = " ".join(w for w in KEYWORDS[lang].split() if w not in SOFT[lang])
    not_expr = "if else for while do switch case default break continue return throw try catch finally with const let var debugger export"
    if not ts:
        not_expr += " enum"
        words += " enum"
    out = {
        "I": f"[i {soft}]",
        "W": not_expr,
        "O": "i n s r this null true false new",
        "KEY": f"(?: [i n s {soft} {words}] | B )",
        "pre": "(?: (?: for await? | while | with ) P N* | $I ':' N* )",
        "else": "N* else N*",
        "if": "if P N*",
        "T": "(?: ';' N* | N+ | \\Z )",
        "plain": "(?: (?<= P ) N (?= C ) | [^ C P B ';' ',' N ':' '?' $W] | C (?! [$O] ) | P (?! [$O] ) | B (?! [$O] ) )",
        "y": "$plain",
        # A colon belongs to a conditional.
        "x": "(?: $plain+ (?: '?' (?: $plain | '?' | ':' )* ':' (?: $plain | '?' | ':' )* )? )",
        "xs": "(?: $x (?: ',' N* $x )* )",
        "ann": "(?: '@' $I (?: '.' $I )* P? N* )",
        "GEN": "",
        "RET": "",
        "TYPED": "",
        "bind": "(?: (?: $I | B | C ) $TYPED (?: '=' $x )? )",
        "var": "(?: (?: const | let | var ) $bind (?: ',' N* $bind )* $T )",
        "fn": "(?: async? function '*'? $I $GEN P $RET N* $body )",
        "fn0": "(?: async? function '*'? $I? $GEN P $RET N* $body )",
        "body": "C",
        "cls": "(?: $ann* class $I $GEN N* (?: extends $plain+? N* )? $impl C )",
        "cls0": "(?: $ann* class (?: extends $plain+? )? C )",
        "impl": "",
        "type": "(?!)",
        "try": "(?: try N* C N* (?: catch P? N* C (?: N* finally N* C )? | finally N* C ) )",
        "simple": "(?: ';' | N | C | $var | return $xs? $T | throw $xs $T | (?: break | continue ) $I? $T | debugger $T | $fn | $cls | $type | $try | switch P N* C | do N* $pre* (?: C | ';' | $xs $T ) N* while P ';'? | import [P '.'] (?: $plain | ',' )* $T | (?! import | function | class | C ) $xs $T )",
        "from": "(?: from s (?: [i with] C )? )",
        "import": "(?: import (?: s | (?: $I (?: ',' (?: C | '*' as $I ) )? | C | '*' as $I ) from s ) (?: [i with] C )? $T )",
        "export": "(?: export (?: default (?: $fn0 | $cls | $cls0 | $type | (?! function | class ) $xs $T ) | C $from? $T | '*' (?: as (?: $I | s | default ) )? $from $T | $var | $fn | $cls | $type ) )",
        "module": "(?: $import | $export )",
        "label": "(?: N* (?: case $xs | default ) ':' )",
        "prop": "(?: '...' $x | (?: async | get | set | '*' | static )* $KEY $GEN P $RET C | $KEY (?: ':' $x | '=' $x )? )",
        "object": "N* (?: $prop N* (?: ',' N* $prop N* )*+ ','? N* )?",
        "member": "(?: ';' | N | static C | (?: $ann | $mods )* $KEY $GEN P $RET $body | (?: $ann | $mods )* $KEY ['?' '!']? $TYPED (?: '=' $x )? $T )",
        "mods": "(?: [static async get set '*'] N* )",
        "members": "(?: $member )*+",
        "spec": "(?: $KEY (?: as $KEY )? (?: ',' $KEY (?: as $KEY )? )*+ ','? )?",
        "for": "[^ ';']* ';' [^ ';']* ';' [^ ';']* | (?: const | let | var )? [^ ';' of in '=' const let var]+ (?: of | in ) [^ ';' const let var]+",
        "cond": "$xs",
        "caught": "$I | B | C",
        "list": "(?: $x (?: ',' $x )*+ ','? )?",
        "array": "(?: (?: $x )? ',' )*+ (?: $x )?",
    }
    if ts:
        types = f"i n s {soft} B C P null true false typeof void this new import in function '.' '|' '&' '=>' '?' ':' '...' '-' '+' '*'"
        out |= {
            "GEN": "(?: '<' (?: [" + types + " extends const '=' ',' '<' '>' '>>' N] )*? ['>' '>>' '>>>'] )?",
            "GEN1": "(?: '<' (?: [" + types + " extends const '=' ',' '<' '>' '>>' N] )*? ['>' '>>' '>>>'] )",
            "ty": "(?: N* (?: [" + types + " extends] | $GEN1 )+ )",
            "plain": "(?: (?<= as ) const | $GEN1 (?= [P '.' '=' i] | \\Z ) | [^ C P B ';' ',' N ':' '?' $W] | C (?! [$O] ) | P (?! [$O] ) | B (?! [$O] ) )",
            "x": "(?: (?: $plain | '?' | ':' )+ )",
            "RET": "(?: ':' $ty )?",
            "TYPED": "(?: '!'? ':' $ty )?",
            "body": "(?: C | ';' | N )",
            "cls": "(?: $ann* (?: abstract )? class $I $GEN (?: extends (?: $GEN1 | [^ C ';' N $W] )+ )? $impl C )",
            "impl": "(?: implements (?: $ty | ',' )+? )?",
            "type": "(?: declare? (?: interface $I $GEN (?: extends (?: $ty | ',' )+? )? C | type $I $GEN '=' $ty $T | const? enum $I C | (?: namespace | module ) (?: $I (?: '.' $I )* | s ) C | (?= const | let | var | function | class | abstract | async ) (?: $var | $fn | $cls ) ) )",
            "import": "(?: import (?: s | type? (?: $I (?: ',' (?: C | '*' as $I ) )? | C | '*' as $I ) from s | type? $I '=' $xs ) (?: [i with] C )? $T )",
            "export": "(?: export (?: default (?: $fn0 | $cls | $cls0 | $type | (?! function | class ) $xs $T ) | type? C $from? $T | type? '*' (?: as (?: $I | s | default ) )? $from $T | $type | $var | $fn | $cls | '=' $x $T | as namespace $I $T | $import ) )",
            "mods": "(?: [static async get set '*' abstract declare override private protected public readonly] N* )",
            "member": "(?: ';' | N | static C | (?: $ann | $mods )* $KEY '?'? $GEN P $RET (?: C | $T ) | (?: $ann | $mods )* $KEY ['?' '!']? (?: ':' $ty )? (?: '=' $x )? $T )",
            "tmember": "(?: (?: [readonly get set new '+' '-'] )* (?: $KEY ['?' '+' '-']* )? $GEN P? (?: ':' $ty )? )",
            "tbody": "[';' ',' N]* (?: (?! [';' ',' N] | \\Z ) $tmember (?: [';' ',' N]+ | \\Z ) )*+",
            "enum": "N* (?: $KEY (?: '=' $x )? N* (?: ',' N* $KEY (?: '=' $x )? N* )*+ ','? N* )?",
            "spec": "(?: type? $KEY (?: as $KEY )? (?: ',' type? $KEY (?: as $KEY )? )*+ ','? )?",
            "parg": "(?: (?: $GEN1 | [^ ';' ',' $W] )+ )",
            "list": "(?: $parg (?: ',' $parg )*+ ','? )?",
            "array": "(?: (?: $parg )? ',' )*+ (?: $parg )?",
        }
    return out


RUST = {
    "attr": "(?: '#' '!'? B )",
    "vis": "(?: pub P? )?",
    "O": "i n s c self Self super crate let true false",
    "W": "let fn struct enum trait impl mod use pub static extern type where",
    "op": "'.' '?' '=' '==' '!=' '<=' '>=' '+=' '-=' '*=' '/=' '%=' '^=' '|=' '&=' '<<=' '>>=' as '/' '%' '^' '+'",
    # A condition or a scrutinee may hold a pattern.
    "y": "(?: [^ C ';' $W] | C (?! [$O] ) | let )",
    "x": "(?: (?: [^ C P B ';' else if match while for $W] | [C P B] (?! [$O] ) | (?<= [if while '&&'] ) let | (?<= C ) else | (?: if | match | while ) (?! C ) | for (?= '<' | [^ ';' C]* in ) )+ )",
    "c": "(?: (?: [^ C ';' else $W] | let | C (?= ['=' '.' '?' '|' ] ) )+? )",
    "blk": "(?: (?: l ':' )? (?: if $c C (?: else if $c C )*+ (?: else C )? | (?: match | while ) $c C | for (?= [^ ';']*? in ) $c C | loop C | unsafe C | async move? C | const C | C ) (?! [$op else] ) )",
    "gen": "[^ ';' C fn struct enum use mod let impl trait]*",
    "fn": "(?: (?: const | async | unsafe | extern s? )* fn i (?: $gen | '<' [^ C ';' fn]* '>' $gen | $gen '->' [^ C ';' fn]* ) (?: C | ';' ) )",
    "macro": "(?: (?: i | crate | self | super ) (?: '::' i )* '!' i? (?: [P B] ';' | C ';'? ) )",
    "item": "(?: $attr * $vis (?: ';' | use [^ ';' '=']+ ';' | mod i (?: C | ';' ) | $fn | (?: struct | enum | i ) i $gen (?: C | ';' ) | (?: unsafe | i )? (?: trait | impl ) [^ ';' C fn struct enum use mod let trait impl]+ (?: impl [^ ';' C fn struct]+ )? C"
    " | type i [^ ';']* ';' | (?: const | static ) mut? i ':' [^ ';' '=']+ (?: '=' $x )? ';' | extern s? C | extern crate [^ ';']+ ';' | $macro ) )",
    "items": "(?: '#' '!' B | $item )*+ $attr *",
    "let": "(?: let (?: [^ ';' '=' $W] | fn )+ (?: '=' (?: $x | $attr )+ )? (?: else C )? ';' )",
    "block": "(?: '#' '!' B | $attr *+ (?: ';' | $let | $blk | $macro (?! [$op] ) | $item | (?! ['>' '>>' $op] ) $x ';' ) )*+ (?: $attr * (?! ['>' '>>' $op] ) $x )?",
    "pat": "(?: [^ ';' ',' '=>' $W]+ | (?<= [if] ) let )",
    "guard": "(?: (?: [^ ';' ',' '=>' $W] | (?<= [if '&&'] ) let )+ )",
    "armx": "(?: [^ ';' ',' '=>' $W] | (?<= [if while '&&'] ) let )+",
    "arms": "(?: $attr * $guard '=>' (?: C ','? (?= [^ '.' '?'] | \\Z ) | $armx (?: ',' $armx )*? (?: ',' (?= $attr * $guard '=>' | \\Z ) | \\Z ) ) )*+",
    "field": "(?: $attr * $vis i ':' [^ ';' ':' '=']+? (?= ',' (?: '#' | pub | i ':' ) | ','? \\Z ) )",
    "fields": "(?: $field (?: ',' $field )*+ ','? )?",
    "variant": "(?: $attr * $vis i [P C]? (?: '=' [^ ';' ',']+ )? )",
    "enum": "(?: $variant (?: ',' $variant )*+ ','? )?",
    "init": "(?: $attr * ref? mut? (?: [i n] (?: ':' [^ ';' ':' $W]+? (?= ',' (?: '#' | ref | mut | [i n] [':' ','] | [i n]? \\Z | '..' ) | ','? \\Z ) )? ) )",
    "literal": "(?: $init (?: ',' $init )*+ )? ','? (?: '..' (?: [^ ';' ',' $W]+ )? )?",
    "uses": "[i '::' ',' '*' self super crate as C]*",
    "any": "(?s: .* )",
    "arg": "(?: $attr * (?: pub P? )? (?: [^ P B ';' ',' struct enum trait mod use static where] | [P B] (?! [$O] ) )+ )",
    "list": "(?: $arg (?: ',' $arg )*+ ','? )?",
    "array": "(?: [^ ';' ',' $W]+ (?: ';' [^ ';' ',' $W]+ | (?: ',' [^ ';' ',' $W]+ )*+ ','? ) )?",
    "top": "$items",
}

GO = {
    "T": "(?: ';' N? | N | \\Z )",
    "W": "if else for switch select case default break continue return go defer goto fallthrough import package var const",
    "y": "(?: [^ C N ';' ',' $W type] | C (?! [i n s c] ) )",
    "x": "(?: $y )+",
    "xs": "(?: $y | ',' )+",
    "hdr": "(?: (?: [^ C N ';' $W type] | C (?! [i n s c] ) )*? )",
    "hdrs": "(?: $hdr (?: ';' $hdr )? )",
    "if": "(?: if (?! C ) $hdrs C (?: else if (?! C ) $hdrs C )*+ (?: else C )? $T )",
    "spec": "(?: [^ N ';' $W]+ )",
    "decl": "(?: (?: var | const ) (?: i $spec | P ) $T | type (?: i $spec | P ) $T )",
    "st": "(?: N | ';' | C $T | return $xs? $T | (?: break | continue ) i? $T | goto i $T | fallthrough $T | (?: go | defer ) $x $T | $if | for (?: $hdr | $hdr ';' $hdr ';' $hdr | [^ N C ';' $W]*? range $hdr ) C $T | switch $hdrs C $T | select C $T | $decl | i ':' (?! [i n s] ) N? | $xs $T )",
    "block": "(?: $st )*+",
    "cases": "N? (?: (?: case $xs | default ) ':' (?: $st )*+ )*+",
    "fields": "(?: [N ';'] | [^ N ';' $W]+ $T )*+",
    "elem": "(?: $x (?: ':' $x )? )",
    "literal": "(?: $elem (?: ',' $elem )*+ ','? )?",
    "imports": "(?: [N ';'] | [i '.']? s $T )*+",
    "specs": "(?: [N ';'] | $spec $T )*+",
    "list": "(?: (?: $y | type )+ (?: ',' (?: $y )+ )*+ ','? )?",
    "index": "(?: [^ N ';' $W]+ )?",
    "top": "N* package i $T (?: N | ';' | import [i '.']? [s P] $T )*+ (?: N | ';' | func P? i B? P [^ N ';' $W type import package]* $T | (?: var | const | type ) (?: i $spec | P ) $T )*+",
}

PYTHON = {
    "W": "class def for while with try except finally elif del global nonlocal pass break continue return raise import from assert",
    # Parts of an expression without a condition; a lambda brings its colon.
    "a": "(?: '.' (?! '.' ) | [^ '.' N S ':' ';' ',' '=' ':=' '->' '+=' '-=' '*=' '/=' '//=' '%=' '&=' '|=' '^=' '>>=' '<<=' '**=' '@=' if else lambda async as yield $W match case] )",
    "lam": "(?: lambda (?: [i ',' '*' '**' '/'] | '=' (?: $a )+ )* ':' )",
    "d": "(?: (?: $lam | $a )+ )",
    "e": "(?: $d (?: if $d else $d )*+ )",
    "es": "(?: '*'? $e (?: ',' '*'? $e )*+ ','? )",
    "y": "(?: yield (?: from $e | $es )? )",
    "t1": "(?: '*'? (?: [i s P B C] (?: '.' i | B | P )* (?<= [i B] ) | P ) )",
    "t": "(?: $t1 (?: ',' $t1 )*+ ','? )",
    "aug": "['+=' '-=' '*=' '/=' '//=' '%=' '&=' '|=' '^=' '>>=' '<<=' '**=' '@=']",
    "names": "(?: i (?: ',' i )* )",
    "mod": "(?: i (?: '.' i )* (?: as i )? )",
    "small": "(?: import $mod (?: ',' $mod )* | from (?: ['.' '...']* i (?: '.' i )* | ['.' '...']+ ) import (?: '*' | P | i (?: as i )? (?: ',' i (?: as i )? )* ) | return $es? | raise (?: $e (?: from $e )? )? | pass | break | continue"
    " | del $t | (?: global | nonlocal ) $names | assert $e (?: ',' $e )? | i i B? '=' $e | (?: $t '=' )++ (?: $y | $es ) | $t1 $aug (?: $y | $es ) | $t1 ':' $e (?: '=' (?: $y | $es ) )? | $y | $es )",
    "line": "(?: $small (?: ';' $small )*+ ';'? N )",
    "w": "(?: (?: i ':=' )? $e )",
    "item": "(?: $e (?: as $t1 )? )",
    "pattern": "(?: [i n s P B C '|' '.' '-' '+' ',' '*' as None True False]+ )",
    "pattern1": "(?: [i n s P B C '|' '.' '-' '+' '*' as None True False]+ )",
    "If": "if $w ':'",
    "Elif": "elif $w ':'",
    "Otherwise": "else ':'",
    "Loop": "async? (?: for $t in $es | while $w ) ':'",
    "Definition": "(?: async? def i B? P (?: '->' $e )? | class i B? P? ) ':'",
    "With": "async? with (?: P | $item (?: ',' $item )* ) ':'",
    "Try": "try ':'",
    "Except": "except '*'? (?: $es (?: as i )? )? ':'",
    "Finally": "finally ':'",
    "Match": "match (?: '*'? $w ','? )+ ':'",
    "Kase": "case $pattern (?: if $w )? ':'",
    "decorator": "'@' $w N",
    "comp": "(?: (?: async? for $t in $d | if (?: i ':=' )? $d )*+ )",
    "gen": "(?: async? for $t in $d $comp )",
    "arg": "(?: i '=' $e | '**' $e | '*' $e )",
    "sep": "(?: ',' | \\Z )",
    "pos": "(?: '*' $e | $w )",
    "call": "(?: $pos $sep )*+ (?: $arg $sep )*+ | $w $gen",
    "par": "(?: i (?: ':' '*'? $e )? )",
    "params": "(?: (?: $par | '/' ) $sep )*+ (?: (?: $par '=' $e | '/' ) $sep )*+ (?: '*' $par? $sep (?: $par (?: '=' $e )? $sep )*+ )? (?: '**' $par $sep )?",
    "tuple": "(?: (?: '*' $e | $w ) (?: ',' (?: '*' $e | $w ) )*+ ','? )? | $w $gen | $y",
    "imports": "i (?: as i )? (?: ',' i (?: as i )? )*+ ','?",
    "withs": "$item (?: ',' $item )*+ ','?",
    "slice": "(?: '*' $e | $w? ':' $e? (?: ':' $e? )? | $w )",
    "index": "(?: $slice (?: ',' $slice )*+ ','? | $w $gen )?",
    "tpars": "(?: '*'? '*'? i (?: ':' $e )? (?: ',' | \\Z ) )+ | (?: '**' i )",
    "entry": "(?: $e ':' $e | '**' $e )",
    "dict": "(?: $entry (?: ',' $entry )*+ ','? | $e ':' $e $gen | (?: '*' $e | $w ) (?: ',' (?: '*' $e | $w ) )*+ ','? | $w $gen )?",
    "casep": "(?: $pattern1 $sep )*+ (?: i '=' $pattern1 $sep )*+",
    "casec": "(?: $pattern1 ':' $pattern1 $sep )*+ (?: '**' i ','? )?",
}

#: XML and YAML have kinds of their own, all plain letters and signs.
XML = {"top": r"p?m*(?:om*)?[Pe]m*|[m]*", "inside": r"[temPs]*"}
_V, _ITEM = "[vbBC]", "(?:[vbBC]N|NS?|S)"
YAML = {
    "top": r"D*S?(?:D+S?)*",
    "level": rf"(?:k(?:{_V}N|N(?:S|(?:e{_ITEM})++)?)|q{_ITEM}(?:w{_ITEM})?)++|(?:e{_ITEM})++|{_V}N",
    "flow": r"(?:(?:[vBC](?::[vBC]?)?|:[vBC]?)(?:,(?:[vBC](?::[vBC]?)?|:[vBC]?))*+,?)?",
}
RULES = {"java": JAVA, "c": C, "javascript": _ecma(False), "typescript": _ecma(True), "rust": RUST, "go": GO, "python": PYTHON}


def _is(prev: str, *names: str) -> bool:
    return prev in {CODE.get(n, n) for n in names}


@lru_cache(maxsize=65536)
def roles(lang: str, bracket: str, prev: str, head: str = "") -> tuple[str, ...]:
    """Productions that the content of a group may follow, the likeliest first; `bracket` is '' for a whole file, `prev` the
    kind before it and, where that is a closing parenthesis, `head` the kind before the opening one."""
    if bracket == "":
        return ("top",)
    if lang == "xml":
        return ("inside",)
    if lang == "yaml":
        return ("level",) if bracket == ">" else ("flow",)
    at = lambda *names: _is(prev, *names)
    if lang == "python":
        if bracket == ">":
            return "block", "cases"
        if bracket == "(":
            operand = at("i", ")", "]", "}", "s", "n")
            return ("call", "params", "casep") if operand else ("imports",) if at("import") else ("tuple", "withs", "casep")
        return ("index", "tpars", "casep") if bracket == "[" else ("dict", "casec")
    if bracket == "(":
        if lang == "go":
            return ("imports",) if at("import") else ("specs",) if at("var", "const", "type") else ("list",)
        if lang == "rust":
            return ("any",) if at("!", "#") else ("list", "any") if at("i") else ("list",)
        if at("for") or (at("await") and lang not in ("java", "c")):
            return ("for", "list") if at("await") else ("for",)
        if at("if", "while", "switch", "synchronized", "with"):
            return ("cond",)
        if at("catch"):
            return ("caught", "list") if lang == "typescript" else ("caught",)
        return ("resources",) if at("try") and lang == "java" else ("list",)
    if bracket == "[":
        if lang == "rust":
            return ("any",) if at("!", "#") else ("array",)
        return ("array",) if lang in ("javascript", "typescript") else ("index",)
    if lang == "java":
        if at("=", "]", ",", "("):
            return "array", "block"
        if at("->", "else", "do", "try", "finally", "static", ";", ":"):
            return "block", "switch"
        if at("{", "}"):
            return "block", "array", "members"
        if at(")"):
            return ("switch",) if _is(head, "switch") else ("block", "members") if head in (IDENT, CODE[">"]) else ("block",)
        return "members", "enum", "block", "module"
    if lang == "c":
        if at("=", ",", "(", "]"):
            return ("init",)
        if at("else", "do", ";", ":", "}"):
            return "block", "init"
        if at("{", ")"):
            return "block", "init"
        return ("enum", "fields") if at("enum") else ("fields",) if at("struct", "union") else ("top",) if at("s") else ("fields", "enum", "block")
    if lang == "go":
        if at("struct", "interface"):
            return ("fields",)
        if at("select", "switch"):
            return ("cases",)
        if at("else", "for", "N", "^", ";", ":"):
            return "block", "literal"
        return "block", "literal", "cases"
    if lang == "rust":
        if at("!"):
            return ("any",)
        if at("::"):
            return ("uses",)
        if at("else", "loop", "unsafe", "move", "async", "|", "||", ";", "{", "}"):
            return ("block", "any") if at("}") else ("block",)
        if at("=", "=>", ",", "("):
            return ("block", "fields", "items", "enum") if at(",") else ("block",)
        return "block", "items", "arms", "fields", "literal", "enum"
    ts = lang == "typescript"
    if at(";", "N", "^", "{", "}", "else", "do", "try", "finally", "catch", "static"):
        return ("block", "tbody") if ts else ("block",)
    if at(")"):
        if _is(head, "switch"):
            return ("switch",)
        return ("block", "tbody", "members") if ts else ("block",) if _is(head, "if", "for", "while", "catch", "with", "function") else ("block", "members")
    if at("=>"):
        return ("block", "tbody") if ts else ("block",)
    if at("class"):
        return ("members",)
    if at("import", "export", "type", "from"):
        return ("spec", "members", "tbody") if ts else ("spec",)
    if at(","):
        return ("object", "spec", "tbody") if ts else ("object", "spec")
    if at(":"):
        return ("object", "block", "tbody") if ts else ("object", "block")
    if at("i", "s") or prev in {CODE[w] for w in SOFT[lang]} or (ts and at(">", ">>", ">>>", "]", "void", "null", "this", "n", "true", "false")):
        return ("members", "tbody", "block", "enum", "object", "top") if ts else ("members", "object") if not at("i", "s") else ("members",)
    return ("object", "tbody") if ts else ("object",)


@lru_cache(maxsize=1024)
def production(lang: str, name: str) -> re.Pattern:
    if lang in ("xml", "yaml"):
        return re.compile({"xml": XML, "yaml": YAML}[lang][name])
    return _compile(RULES[lang], name)


#: Statements that nest without braces: R a loop or label before one, I a condition, L an else, Z any other statement. An
#: else belongs to a condition before it; several may end a statement only where conditions stand directly in each other.
_CHAIN = "(?:R*IR*I(?:R*I)*R*Z(?:L(?:R*I)*R*Z)*+|R*IR*Z(?:LR*IR*Z)*LR*I(?:R*I)+R*Z(?:L(?:R*I)*R*Z)*+|R*IR*Z(?:LR*IR*Z)*+(?:LR*Z)?|R*Z)"
_LEADS = (("L", "else"), ("I", "if"), ("R", "pre"), ("Z", "simple"))
#: Productions over units: the units in the order in which they are tried, and the sequences of them that are admissible.
UNITS = {
    ("java", "block"): (_LEADS, f"{_CHAIN}*+"),
    ("java", "switch"): ((("A", "arrow"), ("K", "label"), *_LEADS), f"A*+|(?:K(?:K|{_CHAIN})*+)?"),
    ("c", "block"): (_LEADS, f"{_CHAIN}*+"),
} | {
    (lang, name): units
    for lang in ("javascript", "typescript")
    for name, units in (
        ("block", (_LEADS, f"{_CHAIN}*+")),
        ("switch", ((("K", "label"), *_LEADS), f"(?:K(?:K|{_CHAIN})*+)?")),
        ("top", ((("M", "module"), *_LEADS), f"(?:M|{_CHAIN})*+")),
    )
}


@lru_cache(maxsize=64)
def _units(lang: str, name: str) -> tuple[re.Pattern, re.Pattern]:
    units, order = UNITS[lang, name]
    rules = RULES[lang]
    return _compile(rules | {"": "|".join(f"(?P<{n}>${r})" for n, r in units)}, ""), re.compile(order)


def _reduced(lang: str, name: str, content: str) -> bool:
    """Reduce each statement to a letter, then look at their order."""
    unit, order = _units(lang, name)
    letters, at = [], 0
    while at < len(content):
        m = unit.match(content, at)
        if not m or m.end() == at:
            return False
        letters.append(m.lastgroup)
        at = m.end()
    return bool(order.fullmatch("".join(letters)))


#: Lines of Python reduced to letters: the first of a header's name, z for simple lines; b after a header with its block.
_LINE = re.compile("S?[^NS]*N")
_HEADERS = {CODE[w]: names for w, names in {
    "if": ["If"], "elif": ["Elif"], "else": ["Otherwise"], "for": ["Loop"], "while": ["Loop"], "def": ["Definition"], "class": ["Definition"], "with": ["With"],
    "async": ["Loop", "Definition", "With"], "try": ["Try"], "except": ["Except"], "finally": ["Finally"], "match": ["Match"], "case": ["Kase"],
}.items()}
_LINES = re.compile("(?:z|@*Db|Ib(?:Eb)*+(?:Ob)?|Lb(?:Ob)?|Wb|MB|Tb(?:(?:Xb)++(?:Ob)?(?:Fb)?|Fb))++")
_CASES = re.compile("(?:Kb)++")


@lru_cache(maxsize=1 << 17)
def _line(line: str) -> str:
    """Letters of one line, '!' if it follows no production; a header that wants a block ends in ':'."""
    first = line[0]
    if first == CODE["@"]:
        return "@" if production("python", "decorator").fullmatch(line) else "!"
    for name in _HEADERS.get(first, ()):
        if m := production("python", name).match(line):
            letter = "X" if name == "Except" else name[0]
            rest = line[m.end() :]
            if rest == LINE:
                return letter + ":"
            return letter + "b" if letter != "M" and production("python", "line").fullmatch(rest) else "!"
    return "z" if first not in _HEADERS and production("python", "line").fullmatch(line) else "!"


def _suite(name: str, content: str) -> bool:
    """A block of Python: each line is reduced, then the order of the lines is looked at."""
    letters, wants, at = [], False, 0
    for m in _LINE.finditer(content + "N"):
        if m.start() != at:
            return False
        line, at = m[0], m.end()
        if line[0] == BLOCK:
            if not wants:
                return False
            letters.append("B" if letters[-1] == "M" else "b")
            wants, line = False, line[1:]
        if wants or at > len(content) and line != LINE:
            return False
        if at > len(content):
            break
        got = _line(line)
        if got == "!":
            return False
        wants = got[-1] == ":"
        letters.append(got.rstrip(":"))
    if wants:
        return False
    whole = "".join(letters)
    return whole == "" and name == "top" or bool((_CASES if name == "cases" else _LINES).fullmatch(whole))


def admissible(lang: str, bracket: str, prev: str, head: str, content: str) -> bool:
    """Whether the content of a group follows one of its productions."""
    if lang == "c" and DIRECTIVE in content:
        content = content.replace(DIRECTIVE, "")
    for name in roles(lang, bracket, prev, head):
        if (lang, name) in UNITS:
            ok = _reduced(lang, name, content)
        elif lang == "python" and name in ("top", "block", "cases"):
            ok = _suite(name, content)
        else:
            ok = bool(production(lang, name).fullmatch(content))
        if ok:
            return True
    return False
