"""Error messages in the words of users."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (pattern in any case, message; $1 is its first group), the first that fits.
MESSAGES = (
    (r"no such file or directory[:\s]*(.+)", "ファイルが見つかりません: $1"),
    (r"permission denied[:\s]*(.+)", "ファイルへのアクセスが拒否されました: $1"),
    (r"file not found[:\s]*(.+)", "ファイルが見つかりません: $1"),
    (r"is a directory[:\s]*(.+)", "ファイルではなくディレクトリが指定されました: $1"),
    (r"file too large", "ファイルサイズが大きすぎます"),
    (r"disk quota exceeded", "ディスク容量が不足しています"),
    (r"no space left on device", "ディスクに空き容量がありません"),
    (r"bad zip.*file", "EPUBファイルが壊れているか、有効なZIPファイルではありません"),
    (r"invalid epub", "有効なEPUBファイルではありません"),
    (r"container\.xml.*not found", "EPUBのcontainer.xmlが見つかりません（壊れたEPUBファイルの可能性があります）"),
    (r"opf.*not found", "EPUBのcontent.opfが見つかりません"),
    (r"spine.*empty", "EPUBのspineが空です（章が含まれていません）"),
    (r"pdf.*encrypt", "PDFファイルは暗号化されています（パスワード保護されたPDFは対応していません）"),
    (r"pdf.*password", "PDFファイルにはパスワードが設定されています"),
    (r"pdfminer.*error", "PDFの解析に失敗しました（テキスト抽出できないPDFの可能性があります）"),
    (r"scan.*pdf", "スキャンPDF（画像PDF）はテキスト抽出に対応していません"),
    (r"unicode.*encode.*error", "文字コードの変換に失敗しました（--verbose オプションで詳細を確認してください）"),
    (r"codec.*can.*encode", "対応していない文字が含まれています"),
    (r"'(utf-?8|utf_8|cp932|shift.?jis)'.*codec", "文字コード '$1' での変換に失敗しました"),
    (r"connection.*refused", "接続が拒否されました（ネットワーク設定を確認してください）"),
    (r"timeout", "接続タイムアウトが発生しました"),
    (r"memoryerror|out of memory", "メモリ不足です（ファイルサイズを小さくするか、不要なアプリを閉じてください）"),
    (r"cannot identify image file", "画像ファイルを認識できません（壊れた画像の可能性があります）"),
    (r"image.*too.*large", "画像サイズが大きすぎます"),
    (r"cannot load.*pango|gtk.*not.*found|gtk.*error", "GTK/Pangoが見つかりません（PDF出力にはGTKのインストールが必要です。代わりにHTMLファイルを生成できます）"),
    (r"java.*not.*found|cannot.*find.*java", "Javaが見つかりません（epubcheck完全検証にはJavaのインストールが必要です）"),
    (r"module.*not.*found.*'([^']+)'", "パッケージ '$1' がインストールされていません（pip install $1 を実行してください）"),
    (r"no module named '([^']+)'", "パッケージ '$1' がインストールされていません（pip install $1 を実行してください）"),
)


def user_message(message: Column) -> Column:
    """The message with the first place that the first fitting pattern finds put into the words of users; others stay."""
    out = message
    for pattern, words in reversed(MESSAGES):
        # all up to the first place is a group of its own, so that only that place is replaced
        first = rf"\A((?s:.*?))(?:(?i){pattern})"
        out = F.when(message.rlike(f"(?i){pattern}"), F.regexp_replace(message, first, "$1" + re.sub(r"\$1", "$2", words))).otherwise(out)
    return out


def verbose_message(message: Column) -> Column:
    """The words of users, and the message itself below where they differ."""
    words = user_message(message)
    return F.when(words != message, F.concat(words, F.lit("\n  (詳細: "), message, F.lit(")"))).otherwise(words)
