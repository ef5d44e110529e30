"""The coder of ``token_coder`` as JVM code: the same blocks, byte for byte, as Spark functions.

The Java below is compiled by Janino, which Spark itself brings for its generated code, once a session, and its classes go to the executors
as a jar like any other. ``encode`` takes a segment's ids (little-endian 32-bit integers) to its blocks, ``decode`` takes
blocks back and fails on a damaged one. ``cut`` takes a segment's texts to their distinct pieces and the pieces' places; ``pieces`` reads that.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType

from . import token_coder as tc

_NUMBERS = {
    "BLOCK": tc.BLOCK, "LANES": tc.LANES, "BITS": tc.SLOT_BITS, "PARTS": tc._PARTS, "WHOLE": tc._WHOLE, "RATE": tc._RATE, "LEAST": tc._LEAST, "SHARES": tc._SHARES, "HEAD": tc._HEAD.size,
}

_MODEL = r"""
package PACKAGE;

public final class Model {
  NUMBERS
  static final int SLOTS = 1 << BITS;
  static final int[] SHIFT = {SHIFTS};
  static final int[] START = {STARTS};
  static final long MASK = (1L << 48) - 1;
  static final byte[] MAGIC = {MAGIC_BYTES};

  static final int[] INVERSE = {INVERSES};
  // four parts of 16 bits in a long, the first lowest; ONES times such a long is its running sums
  static final long ONES = 0x0001000100010001L;

  final long[] p0 = new long[SLOTS * 4], p1 = new long[SLOTS * 4], p2 = new long[SLOTS * 4];
  final byte[] u0 = new byte[SLOTS], u1 = new byte[SLOTS], u2 = new byte[SLOTS];
  final int[] weights = new int[8 * START.length];
  long one, two, near, far, node, c0, c1, c2, c3;  // c: running sums within each four of the mixture
  int s0, s1, s2, a0, a1, a2, at, b1, b2, b3, total;  // b: what comes before the fours
  int before, part;

  void reset() {
    java.util.Arrays.fill(p0, PARTS / 16 * ONES);
    java.util.Arrays.fill(p1, PARTS / 16 * ONES);
    java.util.Arrays.fill(p2, PARTS / 16 * ONES);
    java.util.Arrays.fill(u0, (byte) 0);
    java.util.Arrays.fill(u1, (byte) 0);
    java.util.Arrays.fill(u2, (byte) 0);
    for (int k = 0; k < 8; k++) System.arraycopy(START, 0, weights, k * START.length, START.length);
    one = 0;
    two = 0;
  }

  void begin() {
    node = 1;
    near = one * 0x2545F491L + 0x1B873593L & 0x7FFFFFFFL;
    far = near * 0x5BD1E995L + two * 0x27D4EB2FL & 0x7FFFFFFFL;
  }

  void predict(int place) {
    long spread = node * 0x9E3779B1L;
    s0 = (int) (spread * 0x85EBCA6BL >> 15) & SLOTS - 1;
    s1 = (int) ((spread ^ near) * 0x85EBCA6BL >> 15) & SLOTS - 1;
    s2 = (int) ((spread ^ far) * 0x85EBCA6BL >> 15) & SLOTS - 1;
    a0 = u0[s0];
    a1 = u1[s1];
    a2 = u2[s2];
    at = (place * 9 + Math.min(a1, 2) * 3 + Math.min(a2, 2)) * 3;
    long w0 = weights[at] * SHARES >> 16, w1 = weights[at + 1] * SHARES >> 16, w2 = weights[at + 2] * SHARES >> 16;
    int o0 = s0 << 2, o1 = s1 << 2, o2 = s2 << 2;
    c0 = (p0[o0] * w0 + p1[o1] * w1 + p2[o2] * w2 + ONES) * ONES;
    c1 = (p0[o0 + 1] * w0 + p1[o1 + 1] * w1 + p2[o2 + 1] * w2 + ONES) * ONES;
    c2 = (p0[o0 + 2] * w0 + p1[o1 + 2] * w1 + p2[o2 + 2] * w2 + ONES) * ONES;
    c3 = (p0[o0 + 3] * w0 + p1[o1 + 3] * w1 + p2[o2 + 3] * w2 + ONES) * ONES;
    b1 = (int) (c0 >>> 48);
    b2 = b1 + (int) (c1 >>> 48);
    b3 = b2 + (int) (c2 >>> 48);
    total = b3 + (int) (c3 >>> 48);
  }

  /** Set the sum before a value and its part. */
  void of(int value) {
    int four = value >> 2;
    within(four == 0 ? c0 : four == 1 ? c1 : four == 2 ? c2 : c3, four == 0 ? 0 : four == 1 ? b1 : four == 2 ? b2 : b3, (value & 3) << 4);
  }

  void within(long c, int first, int bit) {
    int low = (int) (c << 16 >>> bit) & 0xFFFF;
    before = first + low;
    part = ((int) (c >>> bit) & 0xFFFF) - low;
  }

  /** The value whose interval holds ``aim``, the last one if none does; sets the sum before it and its part. */
  int at(long aim) {
    int four = aim < b2 ? aim < b1 ? 0 : 1 : aim < b3 ? 2 : 3;
    long c = four == 0 ? c0 : four == 1 ? c1 : four == 2 ? c2 : c3;
    int first = four == 0 ? 0 : four == 1 ? b1 : four == 2 ? b2 : b3;
    long rest = aim - first;
    int lane = (rest >= (c & 0xFFFF) ? 1 : 0) + (rest >= (c >>> 16 & 0xFFFF) ? 1 : 0) + (rest >= (c >>> 32 & 0xFFFF) ? 1 : 0);
    within(c, first, lane << 4);
    return four << 2 | lane;
  }

  static int part(long[] p, int o, int value) {
    return (int) (p[o + (value >> 2)] >>> ((value & 3) << 4)) & 0xFFFF;
  }

  static void move(long[] p, int o, int shift, int value) {
    long keep = (0xFFFF >> shift) * ONES;
    p[o] -= p[o] >>> shift & keep;
    p[o + 1] -= p[o + 1] >>> shift & keep;
    p[o + 2] -= p[o + 2] >>> shift & keep;
    p[o + 3] -= p[o + 3] >>> shift & keep;
    p[o + (value >> 2)] += (long) (PARTS >> shift) << ((value & 3) << 4);
  }

  static int moved(int w, int x, int inverse) {
    int due = (int) ((long) (w * x >> 8) * inverse >> 8);
    return Math.max(LEAST, Math.min(WHOLE, w + (due - w >> RATE)));
  }

  void update(int value) {
    int o0 = s0 << 2, o1 = s1 << 2, o2 = s2 << 2;
    int x0 = part(p0, o0, value), x1 = part(p1, o1, value), x2 = part(p2, o2, value);
    int w0 = weights[at], w1 = weights[at + 1], w2 = weights[at + 2];
    int inverse = INVERSE[(x0 * w0 + x1 * w1 + x2 * w2 >> 16) + 1];
    weights[at] = moved(w0, x0, inverse);
    weights[at + 1] = moved(w1, x1, inverse);
    weights[at + 2] = moved(w2, x2, inverse);
    move(p0, o0, SHIFT[a0], value);
    move(p1, o1, SHIFT[a1], value);
    move(p2, o2, SHIFT[a2], value);
    if (a0 < SHIFT.length - 1) u0[s0] = (byte) (a0 + 1);
    if (a1 < SHIFT.length - 1) u1[s1] = (byte) (a1 + 1);
    if (a2 < SHIFT.length - 1) u2[s2] = (byte) (a2 + 1);
    node = node * 16 + value;
  }

  void end(long id) {
    two = one;
    one = id;
  }

  static boolean settled(long lo, long size) {
    return (lo ^ lo + size) < 1L << 40;
  }

  static long id(byte[] raw, int k) {
    int i = 4 * k;
    return raw[i] & 255L | (raw[i + 1] & 255L) << 8 | (raw[i + 2] & 255L) << 16 | (raw[i + 3] & 255L) << 24;
  }

  static void put(byte[] out, int i, long number) {
    for (int k = 0; k < 4; k++) out[i + k] = (byte) (number >> 8 * k);
  }

  static long crc(byte[] raw, int from, int to) {
    java.util.zip.CRC32 c = new java.util.zip.CRC32();
    c.update(raw, from, to - from);
    return c.getValue();
  }

  byte[] encoded(byte[] raw, int first, int n, int nibbles) {
    reset();
    byte[] out = new byte[HEAD + 3 * n + 64];
    int end = HEAD;
    System.arraycopy(MAGIC, 0, out, 0, 4);
    out[4] = (byte) nibbles;
    put(out, 5, n);
    put(out, 9, crc(raw, 4 * first, 4 * (first + n)));
    long lo = 0, size = MASK;
    for (int t = first; t < first + n; t++) {
      long id = id(raw, t);
      begin();
      for (int place = 0; place < nibbles; place++) {
        predict(place);
        int value = (int) (id >> 4 * (nibbles - 1 - place)) & 15;
        of(value);
        long unit = size / total;
        lo += unit * before;
        size = unit * part;
        update(value);
        while (true) {
          if (!settled(lo, size)) {
            if (size >= 1L << 24) break;
            size = -lo & (1L << 24) - 1;
          }
          if (end + 8 >= out.length) out = java.util.Arrays.copyOf(out, 2 * out.length);
          out[end++] = (byte) (lo >> 40);
          lo = lo << 8 & MASK;
          size <<= 8;
        }
      }
      end(id);
    }
    for (int bits = 40; n > 0 && bits >= 0; bits -= 8) {
      long number = lo + (1L << bits) - 1 >> bits << bits;
      if (number < lo + size && number <= MASK) {
        for (int k = 0; k < 6 - bits / 8; k++) out[end++] = (byte) (number >> 40 - 8 * k);
        break;
      }
    }
    return java.util.Arrays.copyOf(out, end);
  }

  static int length(byte[] block) {
    boolean fits = block.length >= HEAD && block[4] >= 1 && block[4] <= 8;
    for (int k = 0; fits && k < 4; k++) fits = block[k] == MAGIC[k];
    if (!fits) throw new IllegalArgumentException("not a block of token ids");
    long n = block[5] & 255L | (block[6] & 255L) << 8 | (block[7] & 255L) << 16 | (block[8] & 255L) << 24;
    if (n > (block.length - HEAD + 8) * 8L * 4096) throw new IllegalArgumentException("a block's length does not fit its code");
    return (int) n;
  }

  void decode(byte[] block, int n, byte[] out, int first) {
    reset();
    int nibbles = block[4], at = HEAD;
    long lo = 0, size = MASK, x = 0;
    for (int k = 0; k < 6; k++, at++) x = x << 8 | (at < block.length ? block[at] & 255 : 0);
    for (int t = first; t < first + n; t++) {
      begin();
      for (int place = 0; place < nibbles; place++) {
        predict(place);
        long unit = size / total;
        if (unit == 0) throw new IllegalArgumentException("a block of token ids is damaged");
        int value = at((x - lo) / unit);
        lo += unit * before;
        size = unit * part;
        update(value);
        while (true) {
          if (!settled(lo, size)) {
            if (size >= 1L << 24) break;
            size = -lo & (1L << 24) - 1;
          }
          x = x << 8 & MASK | (at < block.length ? block[at] & 255 : 0);
          at++;
          lo = lo << 8 & MASK;
          size <<= 8;
        }
      }
      long id = node - (1L << 4 * nibbles);
      put(out, 4 * t, id);
      end(id);
    }
    int crc = (int) crc(out, 4 * first, 4 * (first + n));
    for (int k = 0; k < 4; k++) {
      if (block[9 + k] != (byte) (crc >> 8 * k)) throw new IllegalArgumentException("checksum of a block of token ids does not fit");
    }
  }
}
"""

_ENCODE = r"""
package PACKAGE;

public final class Encode implements org.apache.spark.sql.api.java.UDF1 {
  public Object call(Object segment) {
    byte[] raw = (byte[]) segment;
    int n = raw.length / 4;
    byte[][] out = new byte[(n + Model.BLOCK - 1) / Model.BLOCK][];
    Model m = new Model();
    for (int i = 0; i < out.length; i += Model.LANES) {
      int last = Math.min(out.length, i + Model.LANES);
      long all = 0;
      for (int k = i * Model.BLOCK; k < Math.min(n, last * Model.BLOCK); k++) all |= Model.id(raw, k);
      int nibbles = Math.max(1, (67 - Long.numberOfLeadingZeros(all)) / 4);
      for (int b = i; b < last; b++) out[b] = m.encoded(raw, b * Model.BLOCK, Math.min(Model.BLOCK, n - b * Model.BLOCK), nibbles);
    }
    return out;
  }
}
"""

_DECODE = r"""
package PACKAGE;

public final class Decode implements org.apache.spark.sql.api.java.UDF1 {
  public Object call(Object blocks) {
    scala.collection.Seq all = (scala.collection.Seq) blocks;
    int n = 0;
    for (int i = 0; i < all.length(); i++) n = Math.addExact(n, Model.length((byte[]) all.apply(i)));
    byte[] out = new byte[Math.multiplyExact(4, n)];
    Model m = new Model();
    int first = 0;
    for (int i = 0; i < all.length(); i++) {
      byte[] block = (byte[]) all.apply(i);
      m.decode(block, Model.length(block), out, first);
      first += Model.length(block);
    }
    return out;
  }
}
"""

_CUT = r"""
package PACKAGE;

public final class Cut implements org.apache.spark.sql.api.java.UDF2 {
  static final int LETTER = 1, MARK = 2, GRAPH = 4, SOLID = 8, EDGE = 16;
  static final byte[] KINDS = new byte[256];

  static {
    for (int c = 0; c < 256; c++) {
      boolean graph = c > 32 && c < 127, letter = c >= 'A' && c <= 'Z' || c >= 'a' && c <= 'z', mark = "MARKS".indexOf((char) c) >= 0;
      // what begins a character that is surely no white space
      boolean solid = graph || c >= 0xC3 && (c < 0xE1 || c > 0xE3);
      KINDS[c] = (byte) ((letter ? LETTER : 0) | (mark ? MARK : 0) | (graph ? GRAPH : 0) | (solid ? SOLID : 0) | (mark || c == ' ' || c == 10 ? EDGE : 0));
    }
  }

  static boolean is(byte b, int kind) {
    return (KINDS[b & 255] & kind) != 0;
  }

  /** Whether a piece of the text from ``begin`` to ``end`` begins at ``i``, which is within it. */
  static boolean border(byte[] b, int begin, int i, int end) {
    byte c = b[i], last = b[i - 1];
    if (last == 10) return i - 2 >= begin && is(b[i - 2], GRAPH) && is(c, SOLID) || c == ' ' && i + 1 < end && is(b[i + 1], SOLID);
    if (!is(c, EDGE)) return false;
    if (c == ' ') return i + 1 < end && is(b[i + 1], SOLID);
    return c == 10 ? is(last, GRAPH) : is(last, LETTER);
  }

  public Object call(Object texts, Object ends) {
    return new Pieces((byte[]) texts).found((byte[]) ends);
  }
}
"""

_PIECES = r"""
package PACKAGE;

final class Pieces {
  final byte[] b;
  int words, places, bytes;
  int[] slots = new int[1 << 15], from = new int[1 << 14], size = new int[1 << 14], hash = new int[1 << 14], codes;

  Pieces(byte[] texts) {
    b = texts;
    codes = new int[texts.length / 6 + 64];
  }

  void place(int word) {
    if (places == codes.length) codes = java.util.Arrays.copyOf(codes, 2 * places);
    codes[places++] = word;
  }

  boolean same(int word, int h, int start, int end) {
    return hash[word] == h && java.util.Arrays.equals(b, from[word], from[word] + size[word], b, start, end);
  }

  /** The number, from 1 on, of the piece from ``start`` to ``end``. */
  int number(int start, int end, int h) {
    int at = h & slots.length - 1;
    while (slots[at] != 0) {
      if (same(slots[at] - 1, h, start, end)) return slots[at];
      at = at + 1 & slots.length - 1;
    }
    if (words == from.length) {
      from = java.util.Arrays.copyOf(from, 2 * words);
      size = java.util.Arrays.copyOf(size, 2 * words);
      hash = java.util.Arrays.copyOf(hash, 2 * words);
    }
    from[words] = start;
    size[words] = end - start;
    hash[words] = h;
    bytes += end - start;
    words++;
    slots[at] = words;
    if (2 * words > slots.length) widen();
    return words;
  }

  void widen() {
    slots = new int[2 * slots.length];
    for (int w = 0; w < words; w++) {
      int at = hash[w] & slots.length - 1;
      while (slots[at] != 0) at = at + 1 & slots.length - 1;
      slots[at] = w + 1;
    }
  }

  void text(int begin, int end) {
    int i = begin;
    while (i < end) {
      int start = i, h = b[i++];
      while (i < end && !Cut.border(b, begin, i, end)) h = h * 31 + b[i++];
      h *= 0x9E3779B1;
      place(number(start, i, h ^ h >>> 15));
    }
    place(0);
  }

  byte[] found(byte[] ends) {
    int begin = 0;
    for (int t = 0; t < ends.length / 4; t++) {
      int end = (int) Model.id(ends, t);
      text(begin, end);
      begin = end;
    }
    byte[] out = new byte[Math.addExact(Math.multiplyExact(4, Math.addExact(words + 3, places)), bytes)];
    Model.put(out, 0, words);
    Model.put(out, 4, places);
    int at = 4 * (words + 3), sum = 0;
    for (int k = 0; k < places; k++, at += 4) Model.put(out, at, codes[k]);
    for (int w = 0; w < words; w++) {
      System.arraycopy(b, from[w], out, at + sum, size[w]);
      sum += size[w];
      Model.put(out, 12 + 4 * w, sum);
    }
    return out;
  }
}
"""

#: A piece may end between a letter and one of these.
MARKS = ",.;:!?#*%&$"

_names: dict[tuple[str, str], str] = {}  # application and session: package of its classes


def _sources(package: str) -> str:
    numbers = "static final int " + ", ".join(f"{k} = {v}" for k, v in _NUMBERS.items()) + ";"
    listed = lambda x: ", ".join(map(str, x))
    model = _MODEL.replace("NUMBERS", numbers).replace("SHIFTS", listed(tc._SHIFT)).replace("STARTS", listed(tc._START.ravel())).replace("MAGIC_BYTES", listed(tc._MAGIC)).replace("INVERSES", listed(tc._INVERSE))
    parts = [model, _ENCODE, _DECODE, _CUT.replace("MARKS\"", MARKS + "\""), _PIECES]
    return f"package {package};\n" + "\n".join(p.replace("package PACKAGE;", "") for p in parts)


def _load(spark: SparkSession) -> str:
    """Compile the classes and give them to this session's executors, once."""
    session = spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID()
    if session not in _names:
        package = f"folioflow_{uuid.uuid4().hex}"
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(_sources(package))
        path = os.path.join(tempfile.mkdtemp(prefix="kernel-"), f"{package}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            classes = compiler.getBytecodes()
            for name in classes.keySet():
                jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        spark.sql(f"ADD JAR '{path}'")
        _names[session] = package
    return _names[session]


def _registered(spark: SparkSession, kind: str, result: DataType) -> str:
    package = _load(spark)
    name, java = f"{package}_{kind.lower()}", spark._jvm
    loader = java.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
    function = java.java.lang.Class.forName(f"{package}.{kind}", True, loader).newInstance()
    spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(result.json()))
    return name


def encode(spark: SparkSession, segment: Column) -> Column:
    """array<binary>: the blocks of a segment's ids."""
    return F.call_function(_registered(spark, "Encode", ArrayType(BinaryType())), segment)


def decode(spark: SparkSession, blocks: Column) -> Column:
    """binary: the ids of a segment's blocks."""
    return F.call_function(_registered(spark, "Decode", BinaryType()), blocks)


def cut(spark: SparkSession, texts: Column, ends: Column) -> Column:
    """binary, for ``pieces``: of texts (UTF-8, one after another; where each ends, as little-endian 32-bit integers) the distinct pieces and where they stand.

    A piece begins before a blank that a visible character follows, between an ASCII letter and one of ``MARKS``, before a line feed that a visible ASCII
    character precedes, and after such a line feed if a visible character follows. Pieces that might begin with white space outside ASCII are left whole."""
    return F.call_function(_registered(spark, "Cut", BinaryType()), texts, ends)


def pieces(found: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces; of each place, in the texts' order, the piece's number from 1 on, and 0 after each text."""
    words, places = np.frombuffer(found, "<i4", 2).tolist()
    codes = np.frombuffer(found, "<i4", places, 4 * (words + 3))
    ends = (np.frombuffer(found, "<i4", words + 1, 8) + 4 * (words + 3 + places)).tolist()
    return [found[i:j] for i, j in itertools.pairwise(ends)], codes
