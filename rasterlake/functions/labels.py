"""Names of formats, codes and states, in English codes and in the labels that reports show."""

from __future__ import annotations

# Formats by their short names, with what reports call them.
FORMATS = ("BMP", "PNG", "JPEG", "GIF", "TIFF", "PCX")
FULL_NAMES = {
    "BMP": "Windows Bitmap",
    "PNG": "Portable Network Graphics",
    "JPEG": "JPEG / JFIF",
    "GIF": "CompuServe GIF",
    "TIFF": "Tagged Image File Format",
    "PCX": "ZSoft PC Paintbrush",
    "NOT_IMAGE": "Файл не является изображением",
    "UNKNOWN": "Формат не распознан",
}
SHORT_LABELS = {f: f for f in FORMATS} | {"NOT_IMAGE": "нет", "UNKNOWN": "?"}

# Extensions that name a format, and those that a scan takes by default.
EXTENSIONS = {"bmp": "BMP", "dib": "BMP", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "jpe": "JPEG", "jfif": "JPEG", "gif": "GIF", "tif": "TIFF", "tiff": "TIFF", "pcx": "PCX"}
DEFAULT_EXTENSIONS = (".bmp", ".png", ".jpg", ".jpeg", ".jpe", ".gif", ".tif", ".tiff", ".pcx")

# Check states from best to worst as they fold; NOT_IMAGE stands apart.
CHECKS = ("OK", "WARNING", "CORRUPTED", "NOT_IMAGE")
CHECK_LABELS = {"OK": "OK", "WARNING": "предупреждение", "CORRUPTED": "файл повреждён", "NOT_IMAGE": "не изображение"}

# Column titles of the CSV report and the results grid.
CSV_HEADERS = (
    "Файл", "Формат", "Расширение", "Ширина", "Высота", "Разрешение X", "Разрешение Y", "Единицы", "Бит на пиксель", "Бит на канал", "Каналы",
    "Модель цвета", "Сжатие", "Код сжатия", "Размер файла", "Прочитано байт", "Статус", "Замечания", "Цветов", "Энтропия", "Аргумент сжатия", "Путь",
)
GRID_HEADERS = ("Файл", "Формат", "Размер", "Разрешение", "Бит/пикс", "Сжатие", "Статус", "Цветов")
NOT_SET = "не задано"

# BMP headers by size and compressions by code.
BMP_HEADERS = {12: "BITMAPCOREHEADER", 40: "BITMAPINFOHEADER", 52: "BITMAPV2HEADER", 56: "BITMAPV3HEADER", 64: "BITMAPCOREHEADER2", 108: "BITMAPV4HEADER", 124: "BITMAPV5HEADER"}
BMP_COMPRESSIONS = {0: "BI_RGB", 1: "BI_RLE8", 2: "BI_RLE4", 3: "BI_BITFIELDS", 4: "BI_JPEG", 5: "BI_PNG", 6: "BI_ALPHABITFIELDS", 11: "BI_CMYK", 12: "BI_CMYKRLE8", 13: "BI_CMYKRLE4"}

# PNG colour types with their channels, and rendering intents.
PNG_COLOURS = {0: ("grayscale", 1), 2: ("RGB", 3), 3: ("palette", 1), 4: ("grayscale + alpha", 2), 6: ("RGBA", 4)}
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_INTENTS = {0: "perceptual", 1: "relative colorimetric", 2: "saturation", 3: "absolute colorimetric"}

# JPEG frames and EXIF orientations.
SOF_NAMES = {
    0xC0: "SOF0 baseline DCT, Huffman", 0xC1: "SOF1 extended sequential DCT, Huffman", 0xC2: "SOF2 progressive DCT, Huffman", 0xC3: "SOF3 lossless, Huffman",
    0xC5: "SOF5 differential sequential DCT", 0xC6: "SOF6 differential progressive DCT", 0xC7: "SOF7 differential lossless",
} | {m: f"SOF{m - 0xC0} arithmetic coding" for m in (0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)}
ORIENTATIONS = {1: "normal", 2: "mirrored horizontally", 3: "rotated 180", 4: "mirrored vertically", 5: "transposed", 6: "rotated 90 clockwise", 7: "transversed", 8: "rotated 270 clockwise"}

# TIFF field types with their sizes, and names of tags and codes.
TIFF_TYPES = {1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1), 7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8), 13: ("IFD", 4), 16: ("LONG8", 8), 17: ("SLONG8", 8), 18: ("IFD8", 8)}
TIFF_TAGS = {
    254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 263: "Threshholding", 264: "CellWidth", 265: "CellLength",
    266: "FillOrder", 269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts",
    280: "MinSampleValue", 281: "MaxSampleValue", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 285: "PageName", 286: "XPosition", 287: "YPosition", 288: "FreeOffsets", 289: "FreeByteCounts",
    290: "GrayResponseUnit", 291: "GrayResponseCurve", 292: "T4Options", 293: "T6Options", 296: "ResolutionUnit", 297: "PageNumber", 301: "TransferFunction", 305: "Software", 306: "DateTime", 315: "Artist",
    316: "HostComputer", 317: "Predictor", 318: "WhitePoint", 319: "PrimaryChromaticities", 320: "ColorMap", 321: "HalftoneHints", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts",
    330: "SubIFDs", 332: "InkSet", 333: "InkNames", 334: "NumberOfInks", 338: "ExtraSamples", 339: "SampleFormat", 340: "SMinSampleValue", 341: "SMaxSampleValue", 347: "JPEGTables", 512: "JPEGProc",
    513: "JPEGInterchangeFormat", 514: "JPEGInterchangeFormatLength", 529: "YCbCrCoefficients", 530: "YCbCrSubSampling", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite", 700: "XMP", 33432: "Copyright", 34665: "ExifIFD", 34675: "ICCProfile",
}
TIFF_COMPRESSIONS = {1: "none", 2: "CCITT Group 3", 3: "CCITT T.4", 4: "CCITT T.6", 5: "LZW", 6: "JPEG (old)", 7: "JPEG", 8: "Adobe Deflate", 32773: "PackBits", 32946: "Deflate", 34676: "JBIG", 34677: "JPEG 2000", 34712: "JPEG 2000", 34713: "JPEG XL", 34925: "LZMA", 50000: "Zstandard", 50001: "WebP"}
TIFF_PHOTOMETRICS = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "palette", 4: "transparency mask", 5: "CMYK", 6: "YCbCr", 8: "CIELab"}
TIFF_UNITS = {1: "none", 2: "inch", 3: "centimetre"}
TIFF_PREDICTORS = {1: "none", 2: "horizontal differencing", 3: "floating point"}

# PCX versions.
PCX_VERSIONS = {0: "PC Paintbrush 2.5", 2: "PC Paintbrush 2.8 with palette", 3: "PC Paintbrush 2.8 without palette", 4: "Paintbrush for Windows", 5: "Paintbrush 3.0 and later"}

# What a PCX header says of its palette.
PCX_PICTURES = {0: "not given", 1: "colour or black and white", 2: "grayscale"}

# Titles of the text report.
TEXT_HEADERS = ("Файл", "Формат", "Размер", "Разрешение", "Бит/пикс", "Сжатие", "Статус")

# Help texts of the results grid, by column title, and of the states.
COLUMN_HELP = {
    "Файл": "Имя файла вместе с папкой. Имя определяется по сигнатуре файла, а не по расширению.",
    "Формат": "Формат, определённый по сигнатуре первых байт: BMP, PNG, JPEG, GIF, TIFF или PCX.",
    "Размер": "Размер изображения в пикселях, взятый из заголовка файла.",
    "Разрешение": "Разрешение в точках на дюйм. Значение считается из поля заголовка, где это возможно; если поле равно нулю, показывается «не задано».",
    "Бит/пикс": "Число бит на один пиксель (сумма по всем каналам цвета).",
    "Сжатие": "Алгоритм сжатия, записанный в файле: без сжатия, RLE, LZW, DEFLATE и другие.",
    "Статус": "Результат проверки целостности: «ОК», «Предупреждение», «Повреждён» или «Не изображение».",
    "Цветов": "Число различных цветов, найденное при декодировании пикселей.",
}
STATUS_HELP = (
    "Статус «ОК» означает, что сигнатура и заголовки согласованы, а обязательные поля заполнены. «Предупреждение» - файл читается, но есть несоответствия (например, расширение не совпадает с форматом). "
    "«Повреждён» - структура файла нарушена. «Не изображение» - сигнатура не найдена."
)

# Rows of the detail panel with their notes, in order.
PANEL_NOTES = {
    ("Файл", "Имя"): "Имя файла на диске. Используется как заголовок строки в таблице.",
    ("Файл", "Папка"): "Расположение файла, из которого был запущен анализ.",
    ("Файл", "Размер"): "Полный размер файла в байтах.",
    ("Файл", "Прочитано байт"): "Сколько байт реально прочитано: заголовки читаются лениво, поэтому значение обычно намного меньше размера файла.",
    ("Формат", "Сигнатура"): "Первые 8 байт файла. По ним определяется формат независимо от расширения.",
    ("Формат", "Определён как"): "Название формата, соответствующее сигнатуре.",
    ("Формат", "Расширение"): "Расширение файла. Используется только для сравнения с сигнатурой.",
    ("Размер", "Ширина"): "Ширина изображения в пикселях из поля заголовка.",
    ("Размер", "Высота"): "Высота изображения в пикселях из поля заголовка.",
    ("Размер", "Разрешение"): "Разрешение пересчитано в точки на дюйм. Источник значения зависит от формата.",
    ("Размер", "Единицы"): "Единицы, в которых записано разрешение в файле.",
    ("Глубина", "Бит на пиксель"): "Суммарное число бит на пиксель, то есть глубина цвета всей точки.",
    ("Глубина", "Бит на канал"): "Число бит в одном канале цвета.",
    ("Глубина", "Каналы"): "Число цветовых каналов: один - оттенки серого, три - RGB.",
    ("Глубина", "Модель цвета"): "Способ интерпретации значений пикселя, указанный в файле.",
    ("Сжатие", "Метод"): "Алгоритм, которым сжаты пиксели внутри файла.",
    ("Сжатие", "Код"): "Числовой код метода сжатия из заголовка файла.",
    ("Проверка", "Статус"): "Сигнатура и обязательные поля заголовка согласованы.",
    ("Проверка", "Замечание"): "Описание найденного несоответствия или повреждения.",
    ("Пиксели", "Декодер"): "Собственный декодер, который восстановил пиксели изображения.",
    ("Пиксели", "Всего цветов"): "Число различных цветов среди всех пикселей.",
    ("Пиксели", "Оттенки серого"): "Признак того, что во всех пикселях каналы R, G и B равны.",
    ("Пиксели", "Прозрачность"): "Есть ли в изображении непрозрачные пиксели.",
    ("Пиксели", "Средний R"): "Среднее значение красного канала по всем пикселям.",
    ("Пиксели", "Средний G"): "Среднее значение зелёного канала по всем пикселям.",
    ("Пиксели", "Средний B"): "Среднее значение синего канала по всем пикселям.",
    ("Пиксели", "Энтропия"): "Энтропия гистограммы яркости: чем выше значение, тем менее однородно изображение.",
    ("Пиксели", "Коэффициент сжатия"): "Во сколько раз размер файла меньше размера распакованных пикселей.",
}
# Notes that take another's place: a wrong extension, no resolution, a state that isn't OK.
PANEL_MISMATCH = "Расширение не совпадает с определённым форматом, это признак переименованного файла."
PANEL_NO_DPI = "Поле разрешения в файле равно нулю, поэтому DPI не определены."
PANEL_SEE_BELOW = "См. список замечаний ниже."
PANEL_ALPHA_USED = "используется"

#: The rules by code: how bad breaking one is, and when it is broken. What only parsers called by themselves can meet is told apart by `ALONE`.
RULES = {
    "EMPTY": ("NOT_IMAGE", "the file has no bytes"),
    "NO_SIGNATURE": ("NOT_IMAGE", "no known signature"),
    "ROOT": ("CORRUPTED", "a root of the scan can't be listed"),
    "OPEN": ("CORRUPTED", "the file can't be opened"),
    "PARSE": ("CORRUPTED", "reading the header failed for another reason"),
    "EXTENSION": ("WARNING", "the extension names another format, and nothing else is wrong"),
    "DEEP_LIMITED": ("WARNING", "pixels of this kind or number aren't decoded"),
    "DEEP": ("CORRUPTED", "pixels can't be decoded"),
    "BMP_SHORT": ("CORRUPTED", "under 18 bytes"),
    "BMP_DIB_SIZE": ("CORRUPTED", "DIB header not of 12 to 124 bytes"),
    "BMP_NO_DIB": ("CORRUPTED", "DIB header cut off"),
    "BMP_GEOMETRY": ("CORRUPTED", "width or height not positive"),
    "BMP_PLANES": ("WARNING", "planes neither 0 nor 1"),
    "BMP_DEPTH": ("WARNING", "bits a pixel not 1, 2, 4, 8, 16, 24 or 32"),
    "BMP_PALETTE": ("CORRUPTED", "palette cut off"),
    "BMP_FILE_SIZE": ("CORRUPTED", "size in the header over the file's"),
    "BMP_EXTRA": ("WARNING", "over 1024 bytes behind the size in the header"),
    "BMP_OFFSET": ("CORRUPTED", "pixels begin beyond the end"),
    "BMP_TRUNCATED": ("CORRUPTED", "fewer bytes than the rows need"),
    "BMP_IMAGE_SIZE": ("WARNING", "picture size over 512 bytes less than what follows"),
    "PNG_SHORT": ("CORRUPTED", "under 8 bytes"),
    "PNG_SIGNATURE": ("CORRUPTED", "no signature"),
    "PNG_CHUNK": ("CORRUPTED", "a chunk goes beyond the end"),
    "PNG_CRC": ("CORRUPTED", "a wrong checksum"),
    "PNG_IHDR": ("CORRUPTED", "IHDR not of 13 bytes"),
    "PNG_NO_IHDR": ("CORRUPTED", "no IHDR"),
    "PNG_GEOMETRY": ("CORRUPTED", "width or height 0"),
    "PNG_INTERLACE": ("WARNING", "interlace method over 1"),
    "PNG_NO_IDAT": ("CORRUPTED", "no IDAT"),
    "PNG_NO_IEND": ("CORRUPTED", "no IEND"),
    "JPEG_SOI": ("CORRUPTED", "no start marker"),
    "JPEG_SEGMENT": ("WARNING", "a segment of no length"),
    "JPEG_SEGMENT_CUT": ("CORRUPTED", "a segment goes beyond the end"),
    "JPEG_NO_FRAME": ("CORRUPTED", "no frame header"),
    "JPEG_GEOMETRY": ("CORRUPTED", "width or height 0"),
    "JPEG_COMPONENTS": ("WARNING", "over 4 components"),
    "JPEG_PRECISION": ("WARNING", "precision not 8, 12 or 16"),
    "JPEG_NO_SCAN": ("CORRUPTED", "no scan"),
    "JPEG_NO_EOI": ("CORRUPTED", "no end marker in the last 32 bytes"),
    "JPEG_SHORT": ("WARNING", "under 100 bytes"),
    "GIF_SHORT": ("CORRUPTED", "under 13 bytes"),
    "GIF_HEADER": ("CORRUPTED", "no signature"),
    "GIF_PALETTE": ("CORRUPTED", "global palette cut off"),
    "GIF_GEOMETRY": ("CORRUPTED", "width or height 0"),
    "GIF_TRAILER": ("CORRUPTED", "no trailer"),
    "GIF_STRUCTURE": ("WARNING", "blocks out of order, though the file ends in a trailer"),
    "GIF_NO_FRAME": ("CORRUPTED", "no frame"),
    "GIF_LZW": ("CORRUPTED", "LZW code size not 2 to 11"),
    "GIF_FRAME": ("WARNING", "first frame goes beyond the canvas"),
    "TIFF_SHORT": ("CORRUPTED", "under 8 bytes"),
    "TIFF_ORDER": ("CORRUPTED", "no byte order"),
    "TIFF_MAGIC": ("CORRUPTED", "magic number neither 42 nor 43, or a BigTIFF header cut off"),
    "TIFF_CYCLE": ("WARNING", "directories form a cycle"),
    "TIFF_IFD": ("CORRUPTED", "first directory beyond the end"),
    "TIFF_NEXT_IFD": ("CORRUPTED", "a later directory beyond the end"),
    "TIFF_TAGS": ("CORRUPTED", "over 4096 tags"),
    "TIFF_IFD_CUT": ("CORRUPTED", "a directory cut off"),
    "TIFF_TAG_DATA": ("WARNING", "a tag's data beyond the end"),
    "TIFF_CHAIN": ("WARNING", "no place of the next directory"),
    "TIFF_EMPTY": ("CORRUPTED", "no tag"),
    "TIFF_GEOMETRY": ("CORRUPTED", "width or height missing"),
    "TIFF_COMPRESSION": ("WARNING", "no Compression tag"),
    "TIFF_STRIPS": ("WARNING", "no strips"),
    "TIFF_STRIP": ("CORRUPTED", "a strip goes beyond the end"),
    "PCX_SHORT": ("CORRUPTED", "under 128 bytes"),
    "PCX_BOUNDS": ("CORRUPTED", "bounds swapped"),
    "PCX_PLANES": ("CORRUPTED", "planes not 1 to 4"),
    "PCX_LINE": ("CORRUPTED", "too few bytes a line"),
    "PCX_TRUNCATED": ("CORRUPTED", "too short for its picture at the best ratio"),
}
ALONE = ("PNG_SHORT", "PNG_SIGNATURE", "JPEG_SOI", "GIF_HEADER", "TIFF_ORDER")
#: A rule whose breaking ends the walk over a file, so that what follows is missing too.
FOLLOWED = {"JPEG_SEGMENT": "CORRUPTED"}
