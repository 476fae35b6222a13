"""Declarations of source files by column expressions: tokens, bracket depth, statements, rules.

1. One ``regexp_extract_all`` cuts a text into tokens, each with the blanks and comments before it
   (possessive patterns: time in proportion to the text).
2. Running sums over a file's tokens give byte column, line and bracket depth; within a depth the
   last token that follows an opening bracket names the block, and terminators number the
   statements of a block.
3. The tokens of a statement become one line, ``text#line.column.place`` each; what stands in inner
   brackets belongs to the inner block, so the line holds the bare brackets.  Blocks learn the line
   that opens them (head) and what follows them (tail) by an equi-join.
4. Rules are rows: language, context, kind of block, head, pattern.  Each pattern's first group is
   the declared name; a second group marks where a name of raw text ends.

Texts are dealt by file to tasks of about ``TASK_BYTES`` each before they are cut, so no token is
shuffled.  Later shuffles have as many partitions, given by number: what is shuffled packs so well
that Spark, which goes by packed bytes, would join too many of them, and a task's memory would grow
with the table.  For the same reason joins with heads and with texts are merged, never broadcast.  A
statement's line is the longest string that is built.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..sources.stored import stored

# ---------------------------------------------------------------- tokens

_BLANK = r"\s++"
_SLASHES = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_HASHES = r"#(?!\[)[^\n]*+|(?m:^=begin)(?s:.*?)(?m:^=end)"
_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_LONG = r'"""(?s:.*?)(?:"""|\z)'
_BACK = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
_NAME = r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*+"
_MARK = r"::|=>|->|:=|\.\.\.|&&|\|\||[=!<>+*/%|&^-]=|(?s:.)"
_INCLUDE = r"#[ \t]*+include[ \t]*+(?:<[^>\n]*+>|\"[^\"\n]*+\")"


def _tokens(comments, strings, name=_NAME):
    return rf"(?:{_BLANK}|{comments})*+(?:{strings}|{name}|\d[\w.]*+|{_MARK}|\z)"


_C_LIKE = _tokens(_SLASHES, f"{_LONG}|{_DOUBLE}|{_SINGLE}")
#: language -> (comments, pattern of a token with what stands before it)
TOKENS = {
    "rust": (_SLASHES, _tokens(_SLASHES, r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|' + r"'(?:\\[^']++|[^'\\\n])'|'\w++")),
    "javascript": (_SLASHES, _tokens(_SLASHES, f"{_DOUBLE}|{_SINGLE}|{_BACK}", rf"#?{_NAME}")),
    "go": (_SLASHES, _tokens(_SLASHES, rf"{_DOUBLE}|{_SINGLE}|`[^`]*+`")),
    "c": (_SLASHES, _tokens(_SLASHES, rf"{_INCLUDE}|#[^\n\\]*+(?:\\(?s:.)[^\n\\]*+)*+|{_DOUBLE}|{_SINGLE}")),
    "java": (_SLASHES, _C_LIKE),
    "ruby": (_HASHES, _tokens(_HASHES, rf"{_DOUBLE}|{_SINGLE}", r"@{0,2}[\p{L}_][\p{L}\p{M}\p{N}_]*+(?:[?!](?!=)|(?<=\bdef \w{1,60})=(?=\())?")),
    "php": (_SLASHES + "|" + r"#(?!\[)[^\n]*+", _tokens(_SLASHES + "|" + r"#(?!\[)[^\n]*+", rf"<\?(?:php|=)?|\?>|{_DOUBLE}|{_SINGLE}")),
    "csharp": (_SLASHES, _tokens(_SLASHES, rf'\$?@"[^"]*+(?:""[^"]*+)*+"|#[^\n]*+|{_LONG}|{_DOUBLE}|{_SINGLE}')),
    "swift": (_SLASHES, _tokens(_SLASHES, f"{_LONG}|{_DOUBLE}", rf"`?{_NAME}`?")),
    "kotlin": (_SLASHES, _tokens(_SLASHES, f"{_LONG}|{_DOUBLE}|{_SINGLE}", rf"`?{_NAME}`?")),
}
TOKENS |= {"typescript": TOKENS["javascript"], "tsx": TOKENS["javascript"], "cpp": TOKENS["c"]}
#: languages whose statements end with their line
LINES = ("javascript", "typescript", "tsx", "go", "ruby", "swift", "kotlin")

OPENS, CLOSES = ("(", "[", "{"), (")", "]", "}")

# ---------------------------------------------------------------- rules

_T = r"<N>(?: (?:\.|::)~ <N>)*(?: <~ [^;={}]*?>~(?! >#))?(?: \?~)?(?: <[>)*"
_JAVA_MODS = r"(?:@~ <N>(?: <(>)? |(?:public|private|protected|static|final|volatile|transient|abstract|synchronized|native|default|strictfp|sealed)~ )*"
_NO_TYPE = r"(?!(?:return|package|import|throw|new|else|case|assert|yield|class|interface|enum|record|goto|break|continue|if|while|for|switch|do|try|catch|finally|using|namespace|await|delegate|throws|super|this|typedef|delete|friend|template|default|public|private|protected|struct|foreach|lock|fixed|checked|unchecked)~)"
_JAVA_FIELD = rf"^{_JAVA_MODS}{_NO_TYPE}{_T} (<N>)(?=(?: <[>)* [=;,]#)"
_JAVA_MORE = r",~ (<N>)(?=(?: <[>)* [=;,]#)"
_JAVA_PARAMETERS = {"head": r"(?<!(?:^| )(?:catch|try|if|while|switch|for|synchronized)#\S{1,40} )$", "tail": r"^(?:\{@|;#|throws~|->#|\[@)"}
_CS_MODS = r"(?:<[> |(?:public|private|protected|internal|static|readonly|const|virtual|override|abstract|async|sealed|extern|partial|unsafe|volatile|new|event|required|ref)~ )*"
_C_TYPE = r"(?:(?:const|volatile|static|extern|register|inline|virtual|mutable|explicit|constexpr|struct|enum|union|class|unsigned|signed)~ )*<N>(?: (?:::~ )?<N>| <~ [^;={}]*?>~)*?"
_C_ACCESS = r"^(?:(?:public|private|protected)~ :~ )*"
_NO_C = r"(?!(?:return|typedef|using|goto|else|delete|case|default|throw|namespace|friend|break|continue|new|template|if|while|for|switch|do|try|catch|sizeof|public|private|protected)~)"
_PRIMITIVE = r"(?:unsigned|signed|long|short|int|char|float|double|void|bool|size_t|ssize_t|u?int\d+_t|u?intptr_t|char\d+_t)~"
_JS_MODS = r"(?:(?:static|async|get|set|public|private|protected|readonly|override|accessor|abstract|declare)~ (?!\(@)|\*~ )*"
_NO_JS = r"(?!(?:if|for|while|switch|catch|with|function|return|do|else|new|await|typeof)~)"
#: an exported declaration's beginning
_EXPORT = r"^(?:export~ )?(?:default~ )?"
_KT_MODS = r"(?:(?:public|private|protected|internal|open|abstract|final|override|lateinit|const|inline|suspend|operator|infix|tailrec|external|data|sealed|enum|annotation|inner|value|companion|expect|actual)~ |@~ <N>(?: <(>)? )*"
_KT_NAME = rf"(?:<N>|<~ [^;{{}}]*?>~)"

BODY, CODE, ANY = ("type", "enum"), ("code", "top"), ("type", "enum", "interface", "code", "top")
#: (context, kinds of block, pattern, options): ``head`` and ``tail`` of the block, ``whole`` line's test, ``before`` (the statement before),
#: ``at`` the statement's start or the second group, ``first`` match alone, ``raw`` text up to the second group, ``last`` part behind a separator
RULES = {
    "rust": [
        ("function", ANY, r"(?:^| )fn~ (<N>)(?= [^;]*\{@)"), ("variable", ANY, r"^let~ (?:mut~ )?(?!mut~)(\S+) .*?(?<= )([:=;]#\S+)", {"raw": True}),
        ("type", ANY, r"(?:^| )(?:struct|enum)~ (<N>)"), ("type", ANY, r"(?:^| )type~ (<N>)(?= [^;]*=#)"), ("constant", ANY, r"(?:^| )(?:const|static)~ (?:mut~ )?(?!fn~|mut~)(<N>) :#"),
        ("import", ANY, r"^(?:pub~ (?:<(> )?)?use~ (\S+) .*?(?<= )(;#\S+)", {"raw": True, "last": "::", "at": "stop", "not": r"[{*]"}),
        ("parameter", ("paren",), r"(?:^|,~ )(?:HASH~ <[> )?(?:mut~ )?(?!mut~|self~)([^\s#:]+#\S+)[^,:]*? (:#\S+)", {"head": r"(?:^| )fn~ <N>(?: <~ .*>~)? $", "raw": True}),
        # typed parameters of closures: the first one behind the opening bar, the others behind the commas up to the closing one
        ("parameter", (*ANY, "paren", "index"), r"(?:(?:^|(?:[=,<>!&*/+-]|=>|&&|\|\||[=!<>]=|move|return)~ )\|~ (?:[^|]*? ,~ )??|(?!^)\G[^|]*? ,~ )(?:HASH~ <[> )?(?:mut~ )?(?!mut~)([^\s#:|,]+#\S+)[^,:|]*? (?=(:#\S+)[^|]*\|~)", {"raw": True}),
        ("field", ("type",), r"(?:^|,~ |\]~ )(?:pub~ (?:<(> )?)?(<N>)(?= :#)", {"head": r"(?:^| )(?:struct|union)~ "}), ("field", ("variant",), r"(?:^|,~ |\]~ )(?:pub~ (?:<(> )?)?(<N>)(?= :#)"),
    ],
    "javascript": [
        ("function", ANY, rf"{_EXPORT}(?:async~ )?function~ (<N>)(?= (?:<~ .*?>~ )?<(>.*\{{@)"),
        ("function", ("type",), rf"^{_JS_MODS}{_NO_JS}(<N>)(?= (?:<~ .*?>~ )?<(> (?::~ .*)?\{{@)"), ("function", ("code", "object"), rf"(?:^|,~ ){_JS_MODS}{_NO_JS}(<N>)(?= <(> \{{@)"),
        ("variable", ANY, rf"{_EXPORT}(?:var|let|const)~ (?!enum~)(\S+)(?: [\]}}]#\S+)?.*?(?<= )(?=([=,;:!$]#\S+))", {"raw": True}), ("variable", ("paren",), r"^(?:var|let|const)~ (\S+)(?: [\]}]#\S+)? ([=,;:]#\S+)", {"raw": True, "head": r"(?:^| )for~ (?:await~ )?$"}),
        ("variable", (*ANY, "paren"), r",~ (<N>|[\[{]@\S+)(?: [\]}]#\S+)? (?=([=,;:!$]#\S+))", {"raw": True, "whole": rf"{_EXPORT}(?:var|let|const)~ "}),
        ("type", ANY, rf"{_EXPORT}class~ (?!extends~)(<N>)"), ("import", ("code", "object", "type"), r"(?:^|,~ )(?:type~ (?!as~|,#|\$#))?(<N>)", {"head": r"^import~ (?:type~ )?(?:<N> ,~ )?$"}),
        ("parameter", ("paren",), r"(?:^|,~ )(<N>)(?= (?:,|\$)#)", {"first": True, "tail": r"^(?:\{@|=>#)", "head": r"(?<!(?:^| )(?:if|for|while|switch|catch|with)#\S{1,40} )$"}),
    ],
    "go": [
        ("function", ANY, r"(?:^| )func~ (?:<(> )?(<N>)(?= (?:<[> )?\(@)"), ("variable", ANY, r"^var~ (<N>)"), ("variable", ("paren",), r"^(<N>)", {"head": r"^var~ $"}), ("variable", (*ANY, "object"), r"(?:^|(?:if|for|switch)~ )(<N>)(?=(?: ,~ <N>)* :=~ (?!range~))"),
        ("type", ANY, r"^type~ (<N>)(?! =#)"), ("type", ("paren",), r"^(<N>)(?! =#)", {"head": r"^type~ $"}), ("constant", ANY, r"^const~ (<N>)"), ("constant", ("paren",), r"^(<N>)", {"head": r"^const~ $"}),
        ("import", ANY, r"^import~ (?:(?:<N>|\.~|_~) )?(\"\S+)", {"last": "/", "at": "second"}), ("import", ("paren",), r"^(?:(?:<N>|\.~) )?(\"\S+)", {"head": r"^import~ $", "last": "/", "at": "start"}),
        ("parameter", ("paren",), r"(?:^|,~ )(<N>)(?: ,~ <N>)* (?=<N>|[*\[(<]|\.\.\.)", {"head": r"(?:^| )func~ (?:(?:<(> )?<N> (?:<[> )?(?:<(> )?)?$"}),
    ],
    "c": [
        ("function", CODE, rf"^{_NO_C}(?:{_C_TYPE} (?:[*&]~ )*)?(?:<N> ::~ )*(<N>)(?= <(> (?:<N> |->~ .*)*(?::~ .*)?(?:\{{@|;#|,#))", {"whole": rf"^(?:{_C_TYPE} (?:[*&]~ )*(?:<N> ::~ )*<N> <(>|(?:<N> ::~ )+<N> <(> .*\{{@)"}),
        ("function", ("type",), rf"{_C_ACCESS}(?:explicit~ |inline~ |constexpr~ )*{_NO_C}(<N>)(?= <(> [^=]*(?:\{{@|;#))", {"whole": rf"{_C_ACCESS}(?:explicit~ |inline~ |constexpr~ )*<N> <(>"}),
        ("variable", CODE, rf"^{_NO_C}{_C_TYPE} (?:[*&]~ )*(<N>)(?=(?: <[>)* [;,]#)"), ("variable", CODE, rf"^{_NO_C}{_C_TYPE} (?:[*&]~ )+(<N>)(?= <(> ;#)"), ("variable", CODE, rf"^{_NO_C}{_C_TYPE} (<N>)(?= =#)"), ("variable", CODE, rf"^{_NO_C}{_C_TYPE} (?:[*&]~ )+<N> =~ (<N>)(?= [;,]#)"),
        ("variable", ("paren",), rf"^{_NO_C}{_C_TYPE} (<N>)(?= =#)", {"head": r"(?:^| )for~ $"}),
        ("type", (*ANY, "paren"), r"(?:^| )(?:struct~ |enum~ (?:class~ |struct~ )?)(<N>)"), ("type", ANY, rf"^typedef~ (?:(?:const|volatile)~ )*(?!(?:struct|enum|union)~|{_PRIMITIVE})(<N>)"),
        ("type", ANY, rf"^typedef~ (?:(?:const|volatile)~ )*(?:{_PRIMITIVE} )+(<N>)(?= [;,]#)"), ("type", ANY, r"^typedef~ (?:(?:const|volatile)~ )*(?:struct|enum|union)~ (?:<N> )?(?:<{> )?(<N>)(?= [;,]#)"),
        ("type", ANY, r"^(<N>)(?= [;,]#)", {"before": r"^typedef~ .*\}#\S+ \$#\S+$"}),
        ("parameter", ("paren",), rf"(?:^|,~ ){_C_TYPE} ((?:[*&]~ )*(?:const~ )?<N>|[*&]#\S+ [*&]#\S+)(?:(?: <[>)*) (?=([,$]#\S+))", {"raw": True, "head": rf"(?:^|:~ ){_NO_C}(?:(?:{_C_TYPE} (?:[*&]~ )*)?(?:<N> ::~ )*~?<N> |.*\)~ )$", "tail": r"^(?:\{@|;#|,#|\$#|const~|override~|noexcept~|:~|->~|=~)", "whole_head": r"^(?!.*(?:^| )(?:return|new|throw)#)"}),
        ("import", (*ANY, "paren", "index"), r"^INCLUDE:(\S+)"),
        ("field", ("type",), rf"{_C_ACCESS}(?!explicit~){_NO_C}(?!.*(?:^| )friend#)(?!(?:struct|enum|class|union)~ (?:<N> )?\{{@){_C_TYPE} ((?:[*&]~ )*<N>)(?: <[>)*(?: <(>(?: (?:const|noexcept|override|final)~)*)? ([;,=:]#\S+|\{{@\S+(?= \}}#\S+ ;#))", {"raw": True}),
    ],
    "java": [
        ("function", (*BODY, "interface"), rf"^{_JAVA_MODS}(?:<~ .*?>~ )?{_NO_TYPE}{_T} {_NO_TYPE}(<N>)(?= <(> (?:<[> )*(?:throws~ .*)?[{{;])", {"head": r"^(?!.*@~ interface#)"}), ("function", BODY, rf"^{_JAVA_MODS}(?:<~ .*?>~ )?{_NO_TYPE}(<N>)(?= <(> (?:throws~ .*)?\{{@)"),
        ("variable", CODE, _JAVA_FIELD), ("variable", (*BODY, "interface"), _JAVA_FIELD), ("variable", (*BODY, "interface"), _JAVA_MORE, {"whole": _JAVA_FIELD}), ("variable", ("paren",), _JAVA_FIELD, {"head": r"(?:^| )for~ $"}),
        ("field", BODY, _JAVA_FIELD), ("constant", ("interface",), _JAVA_FIELD),
        ("type", ANY, r"(?:^| )(?:class|interface|enum|record)~ (?!extends~|implements~)(<N>)(?= (?:[{(]@|<~|extends~|implements~|permits~))"), ("import", ANY, r"^import~ (?:static~ )?(?:<N> \.~ )*(<N>) ;#", {"at": "start"}),
        ("parameter", ("paren",), rf"(?:^|,~ )(?:(?:final~|@~ <N>(?: <(>)?) )*{_NO_TYPE}{_T} (<N>)(?=(?: <[>)* [,$]#)", _JAVA_PARAMETERS),
        # the name behind the dots is a declarator in the grammar
        ("variable", ("paren",), rf"(?:^|,~ )(?:(?:final~|@~ <N>(?: <(>)?) )*{_NO_TYPE}{_T} \.\.\.~ (<N>)(?=(?: <[>)* [,$]#)", _JAVA_PARAMETERS),
    ],
    "ruby": [
        ("function", ANY, r"(?:^| )def~ (?:<N> \.~ )?(<N>)"), ("constant", ANY, r"(?:^|(?:=|then|do|else|and|or|if|unless|while|until|&&|\|\|)~ )([\p{Lu}_]++#\S+)(?= =#)", {"only": r"^\p{Lu}"}), ("variable", ANY, r"(?:^|(?:=|then|do|else|and|or|if|unless|while|until|&&|\|\|)~ )(?![\p{Lu}_]++#)(?!@)(<N>)(?= =#)"),
        ("type", ANY, r"^(?:class|module)~ (<N>(?: ::~ <N>)*)"), ("import", ANY, r"(?:^| )require(?:_relative)?~ (\"\S+|'\S+)", {"last": "/", "at": "keyword"}),
        ("parameter", ("paren",), r"(?:^|,~ )(<N>)(?= (?:,|\$)#)", {"first": True, "head": r"(?:^| )def~ (?:<N> \.~ )?<N> $"}), ("parameter", ("paren",), r"(?:^|,~ )(<N>)(?= [=:]#)", {"head": r"(?:^| )def~ (?:<N> \.~ )?<N> $"}),
        ("parameter", ANY, r"(?:^| )def~ (?:<N> \.~ )?<N> (?:(?:[*&]|<N> [=:])[^,]*,~ )*(<N>)(?= (?:,|\$)#)"), ("parameter", ANY, r"(?:,~ |def~ (?:<N> \.~ )?<N> )(<N>)(?= [=:]#)", {"whole": r"(?:^| )def~ (?:<N> \.~ )?<N> (?![(=])"}),
        ("field", ANY, r"(?:^|(?:=|then|do|else|and|or|if|unless|while|until|&&|\|\|)~ )(@[^\s#@]+#\S+)(?= =#)"),
    ],
    "php": [
        ("function", ANY, r"(?:^| )function~ (?:&~ )?(?!\$)(<N>)(?= \(@)"), ("variable", CODE, r"^static~ (\$\S+)"), ("variable", CODE, r",~ (\$\S+)", {"whole": r"^static~ \$"}), ("type", ANY, r"(?:^| )(?<!::#\S{1,40} )(?:class|interface|trait|enum)~ (?!extends~)(<N>)"),
        ("constant", ANY, r"(?:^| )const~ (?:<N> )?(<N>)(?= =#)"), ("constant", ANY, r",~ (<N>)(?= =#)", {"whole": r"(?:^| )const~ "}), ("import", ("top",), r"(?:^use~ |,~ )(?:(?:function|const)~ )?(\S+) (?:[^,;]*? )?(?=([,;]#\S+))", {"whole": r"^use~ (?!.*\{@)", "raw": True, "last": "\\"}),
        ("parameter", ("paren",), r"(?:^|,~ )[^,$]*?(\$\S+)", {"head": r"(?:^| )(?:function~ (?:&~ )?(?:<N> )?|fn~ (?:&~ )?)$"}), ("field", BODY, r"^(?:(?:public|private|protected|var|static|readonly|final|abstract)~ )+(?:[^,;=$]*? )?(\$\S+)"), ("field", BODY, r",~ (\$\S+)", {"whole": r"^(?:public|private|protected|var|static)~ [^=(]*?\$"}),
    ],
    "csharp": [
        ("function", (*ANY,), rf"^{_CS_MODS}{_NO_TYPE}{_T} {_NO_TYPE}(<N>)(?= (?:<~ [^;=]*?>~ )?<(> (?:where~ [^;]*)?(?:\{{@|;#|=>#))"), ("function", BODY, rf"^{_CS_MODS}{_NO_TYPE}(<N>)(?= <(> (?::~ .*)?(?:\{{@|=>#))"),
        ("variable", ANY, rf"^{_CS_MODS}{_NO_TYPE}{_T} (<N>)(?= [=;,]#)"), ("variable", ("paren",), rf"^{_NO_TYPE}{_T} (<N>)(?= =#)", {"head": r"(?:^| )(?:for|using|fixed)~ $"}), ("field", BODY, rf"^(?!.*(?:^| )event#){_CS_MODS}{_NO_TYPE}{_T} (<N>)(?= [=;,]#)"), ("field", (*BODY, "interface"), rf"^{_CS_MODS}{_NO_TYPE}{_T} (<N>)(?= (?:\{{@|=>#))"),
        ("type", ANY, r"(?:^| )(?:class|struct|interface|enum|record(?:~ class|~ struct)?)~ (?!class~|struct~)(<N>)"), ("type", ANY, rf"^{_CS_MODS}delegate~ {_T} (<N>)"), ("import", ANY, r"^(?:global~ )?using~ (?:static~ )?(?:<N> =~ )?(?:<N> \.~ )*(<N>) ;#", {"at": "start", "head": ""}),
        ("parameter", ("paren",), rf"(?:^|,~ )(?:<[> |(?:ref|out|in|params|this|scoped|readonly)~ )*{_NO_TYPE}{_T} (<N>)(?= [,=$]#)", {"head": r"(?<!(?:^| )(?:catch|if|while|switch|for|foreach|using|lock|fixed)#\S{1,40} )$", "tail": r"^(?:\{@|;#|=>#|where~|:~)", "whole_head": r"^(?!.*(?:^| )(?:return|await|new)#)(?!.*(?:^| )=#)|.*$"}),
    ],
    "swift": [
        ("function", ("type", "enum", "code", "top"), r"(?:^| )func~ (<N>)", {"head": r"^(?!.*(?:^| )protocol#)"}), ("function", BODY, r"^(?:(?:public|private|internal|fileprivate|open|required|convenience|override|nonisolated)~ )*(init#\S+)(?= (?:[?!]~ )?(?:<~ .*>~ )?\(@)", {"head": r"^(?!.*(?:^| )protocol#)"}),
        ("constant", ("type", "enum", "code", "top"), r"^let~ (<N>|\(@\S+)(?: \)#\S+)? ([=:,;$]#\S+)", {"raw": True}), ("variable", ("type", "enum", "code", "top"), r"(?:^| )var~ (<N>|\(@\S+)(?: \)#\S+)? ([=:,;{$][@#]\S+)", {"raw": True, "head": r"^(?!.*(?:^| )protocol#)", "whole": r"^(?!(?:if|guard|while|for|switch)~)"}),
        ("variable", ("type", "enum", "code", "top"), r"^(?:(?!if~|guard~|while~|case~|for~|switch~)(?:<N>|@~|<(>) )+let~ (<N>|\(@\S+)(?: \)#\S+)? ([=:,;$]#\S+)", {"raw": True}),
        ("type", ANY, r"(?:^| )(?<!import#\S{1,40} )(?:class|struct|enum|protocol|extension|actor)~ (?!func~|var~|let~)(<N>(?: \.~ <N>)*)"), ("import", ANY, r"^(?:@~ <N> )?import~ (?:(?:class|struct|enum|func|protocol|typealias|let|var)~ (?=<N> \.))?(?:<N> \.~ )*(<N>)", {"at": "start"}),
        ("parameter", ("paren",), r"(?:^|,~ )(?:<N> )?(<N>)(?= :#)", {"head": r"(?:^| )(?:func~ <N>|init~(?: [?!]~)?)(?: <~ .*>~)? $"}), ("constant", ("enum",), r"^(?:indirect~ )?case~ (<N>)"),
    ],
    "kotlin": [
        ("function", ANY, rf"^{_KT_MODS}fun~ (?:<~ .*?>~ )?(?:<N>(?: <~ [^(]*?>~)?(?: \?~)? \.~ )*(<N>)(?= \(@)"), ("constant", ANY, r"^val~ (?:<~ .*?>~ )?([\p{Lu}_]++#\S+)"), ("variable", ANY, r"^val~ (?![\p{Lu}_]++#)(?:<~ .*?>~ )?(?:<N> \.~ )*(<N>)"),
        ("variable", ANY, rf"^(?!val~){_KT_MODS}(?:val|var)~ (?:<~ .*?>~ )?(?:<N> \.~ )*(<N>)"), ("type", ANY, rf"^{_KT_MODS}(?:fun~ )?(?:class|interface|object|typealias)~ (<N>)"),
        ("import", ANY, r"^import~ (?:<N> \.~ )*(<N>(?: as~ <N>)?)(?= [;$]#)", {"at": "start"}), ("parameter", ("paren",), rf"(?:^|,~ )(?:(?:vararg|val|var|noinline|crossinline)~ |{_KT_MODS[:-1]})*(<N>)(?= :#)", {"head": rf"(?:^| )(?:fun~ (?:<~ .*?>~ )?(?:<N>(?: <~ [^(]*?>~)?(?: \?~)? \.~ )*<N> |class~ <N> (?:<~ .*>~ )?(?:{_KT_MODS}constructor~ )?|constructor~ )$"}),
        ("constant", ("enum",), r"(?:^|,~ )(<N>)(?= (?:,|;|\$)#| \(@| \{@)", {"whole": r"^(?!(?:fun|val|var|companion|override|private|abstract|init|object|class)~)"}),
    ],
}
#: typed parameters are each a pattern there; the plain ones of the table are none
RULES["typescript"] = RULES["tsx"] = [r for r in RULES["javascript"] if r[0] != "parameter"] + [
    ("parameter", ("paren",), r"(?:^|,~ )(?:@~ <N>(?: <(>)? )*(?:(?:public|private|protected|readonly|override)~ )*(\.\.\.#\S+|<N>|[\[{]@\S+).*?(?<= )(?=([?:,=$]#\S+))", {"raw": True, "tail": r"^(?:\{@|=>#|:~|;#|\$#)", "head": rf"(?:(?:^| )(?:function~ (?:\*~ )?(?:<N> )?|constructor~ )|^{_JS_MODS}(?!(?:if|for|while|switch|catch|with|return|new|await|typeof)#)<N> (?:\?~ )?|[=(,:]~ (?:async~ )?|^)(?:<~ .*>~ )?$", "whole_tail": r"^(?:\{@|=>#|:~ (?!.*(?:^| )\?#).*)"}),
]
RULES["cpp"] = RULES["c"]

#: Characters of the pieces that raw names are taken from.
PIECE = 1024
#: Bytes of the texts that a task cuts into tokens, about.
TASK_BYTES = 1 << 20
_NAMED = r"[\p{L}_$@`][^\s#]*+#\S++"


def _pattern(text):
    """A rule's pattern with its marks spelled out: ``~`` a token's place, ``<N>`` a name, ``<(>`` a pair of brackets."""
    for mark, full in (("<N>", f"(?:{_NAMED})"), ("<(>", r"\(@\S++ \)~"), ("<{>", r"\{@\S++ \}~"), ("<[>", r"\[@\S++ \]~")):
        text = text.replace(mark, full)
    return text.replace("~?", "\0").replace("~", r"#\S++").replace("\0", "~?")


# ---------------------------------------------------------------- the scan


def _pattern_of(patterns):
    """Column: the language's pattern.  One expression takes it: a branch for each makes a method so long that the JVM interprets it."""
    return F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair])[F.col("language")]


def tokens(files):
    """(file, language, i, token, line, col, place, depth, first) of a table (file, language, content).

    ``place`` counts characters from 0; ``first`` is true for the first token behind an opening bracket.
    """
    found = F.regexp_extract_all("content", _pattern_of({language: pattern for language, (_, pattern) in TOKENS.items()}), F.lit(0))
    rows = files.select("file", "language", F.posexplode(found).alias("i", "m"))
    # a pattern is needed only where a comment may begin
    rows = rows.withColumn("bare", F.ltrim("m", F.lit(" \t\n\x0b\f\r")))
    comment = F.startswith("bare", F.lit("/")) | F.startswith("bare", F.lit("#")) | F.startswith("bare", F.lit("=begin"))
    behind = F.regexp_replace("m", _pattern_of({language: rf"^(?:{_BLANK}|{comments})*+" for language, (comments, _) in TOKENS.items()}), F.lit(""))
    rows = rows.withColumn("token", F.when(comment, behind).otherwise(F.col("bare"))).drop("bare")
    rows = rows.withColumn("blank", F.expr("substring(m, 1, char_length(m) - char_length(token))"))
    last = lambda c: F.octet_length(F.substring_index(c, "\n", -1))
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    opens, closes = F.col("token").isin(*OPENS), F.col("token").isin(*CLOSES)
    whole = Window.partitionBy("file").orderBy("i")
    before, upto = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "end": F.sum(F.octet_length("m")).over(upto),
        "line": F.lit(1) + F.coalesce(F.sum(breaks("m")).over(before), F.lit(0)) + breaks("blank"),
        "place": F.coalesce(F.sum(F.char_length("m")).over(before), F.lit(0)) + F.char_length("blank"),
        "depth": F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0)) - F.when(closes, 1).otherwise(0),
        "first": F.coalesce(F.lag("token").over(whole).isin(*OPENS) & ~closes, F.lit(False)),
    })
    # bytes up to the start of the token's line: behind the last break of the blanks, or of all that came before
    own = F.when(F.contains("blank", F.lit("\n")), F.col("end") - F.octet_length("token") - last("blank"))
    past = F.when(F.contains("m", F.lit("\n")), F.col("end") - last("m"))
    start = F.coalesce(own, F.max(past).over(before), F.lit(0))
    rows = rows.withColumn("col", F.col("end") - F.octet_length("token") - start + 1)
    return rows.filter("token <> ''").select("file", "language", "i", "token", "line", "col", "place", "depth", "first")


def statements(found):
    """(file, language, block, stmt, s): the line of each statement, with a last token ``$``; ``block`` is its first token's number.

    Blocks of one depth follow each other, so one order of a depth's tokens serves for all its blocks: ``stmt`` goes on through them.
    """
    level = Window.partitionBy("file", "depth").orderBy("i")
    upto = level.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("line") + F.char_length("token") - F.char_length(F.replace("token", F.lit("\n"), F.lit("")))
    rows = found.withColumns({
        "block": F.coalesce(F.last(F.when(F.col("first"), F.col("i")), ignorenulls=True).over(upto), F.lit(-1)),
        "prev": F.when(~F.col("first"), F.lag("token").over(level)), "prev_line": F.when(~F.col("first"), F.lag(ends).over(level)),
    })
    going_on = F.col("prev").rlike(r"^(?:[,.=+/<&|?:(\[{-]|:=|::|=>|->|&&|\|\||==|!=|[+*/-]=|extends|implements)$") | F.col("token").rlike(r"^(?:[.,=?:)\]}{&|]|&&|\|\||\?\.|else|catch|finally|extends|implements|where|throws)$")
    new_line = F.col("language").isin(*LINES) & (F.col("line") > F.col("prev_line")) & ~going_on
    # a line of the preprocessor, and the mark where code begins, stand alone
    directive = F.col("language").isin("c", "cpp", "csharp", "php") & (F.col("prev").rlike(r"^(?:#.|<\?)") | F.col("token").rlike("^#."))
    behind = (F.col("prev") == "}") & ~F.col("token").isin(";", ",", ")", ".", "]", "from", "as", "=", "(", "[")
    cut = F.coalesce((F.col("prev") == ";") | behind | new_line | directive, F.lit(False))
    rows = rows.withColumn("stmt", F.sum(F.when(cut, 1).otherwise(0)).over(upto))
    start = F.substring("token", 1, 1)
    include = F.regexp_replace(F.regexp_extract("token", r"^#[ \t]*include[ \t]*[<\"]+([^>\"]*)", 1), r"[\s]", "\u0001")
    text = (
        F.when(F.col("token").isin(*OPENS), F.concat("token", F.lit("@"), F.col("i").cast("string")))
        .when(start.isin('"', "'", "`"), F.regexp_replace(F.regexp_replace("token", r"\s", "\u0001"), r"[#@(){}\[\];,]", "_"))
        .when((start == "#") & F.col("token").rlike(rf"^{_INCLUDE}$"), F.concat(F.lit("INCLUDE:"), include))
        .when((start == "#") & (F.col("language") == "rust"), "HASH")
        .when(F.contains("token", F.lit("#")) | (F.octet_length("token") > 1) & ~start.between("A", "Z") & ~start.between("a", "z"), F.regexp_replace("token", r"[\s#]", "_"))
        .otherwise(F.col("token"))  # one character, or a word: no blanks in it
    )
    each = lambda *c: [x for k in c for x in (F.lit("."), F.col(k).cast("string"))][1:]
    t = F.concat(text, F.lit("#"), *each("line", "col", "place"))
    own = F.struct("i", t.alias("t"), "line", "col", (F.col("place") + F.char_length("token")).alias("stop"))
    lines = rows.groupBy("file", "language", "block", "stmt").agg(F.array_sort(F.collect_list(own)).alias("own"))
    end = F.element_at("own", -1)
    stop = F.concat(F.lit("$#"), end["line"].cast("string"), F.lit("."), end["col"].cast("string"), F.lit("."), end["stop"].cast("string"))
    return lines.select("file", "language", "block", "stmt", F.concat_ws(" ", F.array_join("own.t", " "), stop).alias("s"))


def placed(lines, tasks):
    """``statements`` with the kind of their block, its head and tail, and the statement before."""
    each = lines.select("file", "language", F.col("block").alias("outer"), "s", F.explode(F.regexp_extract_all("s", F.lit(r"([(\[{]@\d+)#"), F.lit(1))).alias("o"))
    opener = F.expr("substring(o, 1, 1)")
    head = F.expr("substring(s, 1, position(concat(o, '#'), s) - 1)")
    tail = F.regexp_replace(F.expr("substring(s, position(concat(o, '#'), s))"), r"^\S+ (?:[)\]}]#\S+ ?)?", "")
    heads = each.select("file", "language", "outer", (F.substring_index("o", "@", -1).cast("int") + 1).alias("block"), opener.alias("opener"), head.alias("head"), tail.alias("tail"))
    # a Rust enum's body holds variants with bodies of their own
    rust = heads.filter("language = 'rust' AND opener = '{'")
    enums = rust.filter(F.col("head").rlike(r"(?:^| )enum#")).select("file", F.col("block").alias("outer"))
    variants = rust.filter(F.col("head").rlike(_pattern(r"(?:^|,~ |\]~ )<N> $"))).join(enums.hint("merge"), ["file", "outer"]).select("file", "block", F.lit(True).alias("variant"))
    heads = heads.select("file", "block", "opener", "head", "tail").join(variants.hint("merge"), ["file", "block"], "left")
    rows = lines.repartition(tasks, "file", "block").join(heads.hint("merge"), ["file", "block"], "left").withColumn("before", F.lag("s").over(Window.partitionBy("file", "block").orderBy("stmt")))
    head, word = F.col("head"), lambda w: F.col("head").rlike(rf"(?:^| )(?:{w})#")
    ended = head.rlike(r"\)#\S+ (?:(?:const|noexcept|override|final)#\S+ )*$")
    kind = (
        F.when(F.col("opener").isNull(), "top").when(F.col("variant"), "variant").when(F.col("opener") == "(", "paren").when(F.col("opener") == "[", "index")
        .when((F.col("language") == "java") & head.rlike(r"(?:^| )new#\S+ [^={}]*\)#\S+ $"), "type")
        .when(F.col("language").isin("c", "cpp") & (ended | ~word("struct|class|union|enum")), "code").when(F.col("language").isin("c", "cpp") & word("enum") , "enum")
        .when(F.col("language").isin("javascript", "typescript", "tsx") & ~word("class"), F.when(head.rlike(r"(?:\)#\S+ |=>#\S+ |(?:else|do|try|finally)#\S+ )$"), "code").when(head.rlike(r"[=(,:\[?]#\S+ $|return#\S+ $|^import#|^export#\S+ $"), "object").otherwise("code"))
        .when(F.col("language") == "go", "code").when(word("interface"), "interface").when(word("enum"), "enum")
        .when(word("class|struct|record|union|trait|impl|protocol|extension|object|actor"), "type").otherwise("code")
    )
    return rows.withColumn("kind", kind)


def _found(rule):
    """SQL: (context, tok, stop, at, last, bad) of all matches of a rule in a statement, NULL where it does not hold."""
    context, kinds, pattern, *more = rule
    o = more[0] if more else {}
    raw, lit = o.get("raw", False), lambda x: names.text(None if x is None else _pattern(x))
    tests = [f"kind IN ({', '.join(map(names.text, kinds))})"]
    for name, column in (("head", "head"), ("whole_head", "head"), ("tail", "tail"), ("whole_tail", "tail"), ("whole", "s"), ("before", "before")):
        if name in o:
            tests.append(f"coalesce({column}, '') RLIKE {lit(o[name])}")
    group = lambda k: f"regexp_extract_all(s, {lit(pattern)}, {k})"
    found = f"slice({group(1)}, 1, 1)" if o.get("first") else f"arrays_zip({group(1)}, {group(2)})" if raw else group(1)
    tok, stop = ("x.`0`", "x.`1`") if raw else ("x", "CAST(NULL AS STRING)")
    at = {
        "start": "substring_index(s, ' ', 1)", "second": "regexp_extract(s, r'^\\S+ (\\S+)', 1)",  # behind a keyword
        "keyword": "regexp_extract(s, r'((?:^| )require(?:_relative)?#\\S+)', 1)", "stop": stop,
    }.get(o.get("at"), tok)
    if raw:  # a name of one token needs no raw text
        stop = f"IF(contains({tok}, ' ') OR NOT contains(s, concat({tok}, ' ', {stop})), {stop}, NULL)"
    if "only" in o:
        found = f"filter({found}, x -> x RLIKE {lit(o['only'])})"
    each = f"transform({found}, x -> named_struct('context', {names.text(context)}, 'tok', {tok}, 'stop', {stop}, 'at', {at}, 'last', {names.text(o.get('last'))}, 'bad', {names.text(o.get('not'))}))"
    return f"IF({' AND '.join(tests)}, {each}, NULL)"


def _every():
    """Column: the matches of all rules of the statement's language."""
    of = {language: f"flatten(filter(array({', '.join(map(_found, rules))}), r -> r IS NOT NULL))" for language, rules in RULES.items()}
    return F.expr(f"CASE language {' '.join(f'WHEN {names.text(k)} THEN {v}' for k, v in of.items())} END")


def _part(text, number):
    """Column: a number of a token's place: line, column or character."""
    return F.split(F.regexp_extract(text, r"#([\d.]+)(?: .*)?$" if number == "end" else r"^ ?\S*?#(\d[\d.]*)", 1), r"\.")


def tasks_of(files):
    """The number of tasks that cut about TASK_BYTES of the texts each."""
    total = files.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES + 1)


def declarations(files):
    """(file, line, column, identifier, context, language) of a table (file, language, content)."""
    tasks = tasks_of(files)
    # read twice below: as statements, and as the heads of their blocks
    lines = placed(stored(files.sparkSession, statements(tokens(files.repartition(tasks, "file"))), "statements"), tasks)
    rows = lines.select("file", "language", F.explode(_every()).alias("d")).select("file", "language", "d.*")
    at, tok, stop = _part(F.col("at"), "at"), _part(F.col("tok"), "at"), _part(F.col("stop"), "at")
    rows = rows.select("file", "language", "context", F.element_at(at, 1).cast("int").alias("line"), F.element_at(at, 2).cast("int").alias("column"), "tok", "last", "bad", F.element_at(tok, 3).cast("int").alias("p0"), F.when(F.col("stop").isNotNull(), F.element_at(stop, 3).cast("int")).alias("p1"))
    rows = stored(files.sparkSession, rows, "declared")  # read twice: plain names, and names of raw text
    plain = F.replace(F.regexp_replace("tok", r"#\S+", ""), F.lit(" :: "), F.lit("::"))  # one space parts the tokens here
    plain = F.replace(F.replace(plain, F.lit(" . "), F.lit(".")), F.lit("\u0001"), F.lit(" "))
    own = rows.filter("p1 IS NULL").withColumn("name", plain)
    # names of raw text: the text is read again in pieces, each name takes its own
    pieces = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("k", "piece"))
    raw = rows.filter("p1 > p0").repartition(tasks, "file").distinct()
    kept = raw.columns
    raw = raw.withColumn("k", F.explode(F.expr(f"sequence(CAST(p0 div {PIECE} AS INT), CAST((p1 - 1) div {PIECE} AS INT))"))).join(pieces.repartition(tasks, "file", "k").hint("merge"), ["file", "k"])
    part = F.expr(f"substring(piece, greatest(p0 - k * {PIECE}, 0) + 1, least(p1 - k * {PIECE}, {PIECE}) - greatest(p0 - k * {PIECE}, 0))")
    raw = raw.repartition(tasks, "file").groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("k", part.alias("piece")))).alias("all"))
    raw = raw.withColumn("name", F.rtrim(F.array_join("all.piece", ""), F.lit(" \t\r\n"))).drop("all")
    rows = own.unionByName(raw)
    name = F.when(F.col("name").rlike(r"^[\"'`]"), F.regexp_replace("name", r"^[\"'`]+|[\"'`]+$", "")).otherwise(F.col("name"))
    rows = rows.withColumn("n", name)
    name = F.when(F.col("last").isNull(), F.col("n")).otherwise(F.element_at(F.split("n", F.concat(F.lit("\\Q"), "last", F.lit("\\E"))), -1))
    # made by a generator: Spark puts filters before projections with all that they name, so that each name would be made for each filter
    rows = rows.select("file", "line", "column", "context", "language", "bad", F.inline(F.array(F.struct(name.alias("n")))))
    rows = rows.filter(F.col("bad").isNull() | ~F.coalesce(F.rlike("n", "bad"), F.lit(False)))
    # a variable begins at its sigil, which is no part of its name; PHP's variables and fields are measured with it
    bare = F.when(F.col("language").isin("php", "ruby"), F.regexp_replace("n", r"^[$@]+", "")).otherwise(F.col("n"))
    measured = F.when((F.col("language") == "php") & F.col("context").isin("variable", "field"), F.col("n")).otherwise(bare)
    rows = rows.filter((F.octet_length(measured) > 1) & (bare != ""))
    rows = rows.select("file", "line", "column", bare.alias("identifier"), "context", "language")
    return rows.repartition(tasks, "file").dropDuplicates(["file", "line", "column", "identifier", "context"])
