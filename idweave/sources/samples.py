"""Source files with nesting and several declarators, one for each language: ``Qs``, ``Qc`` and ``QP`` stand for a snake, camel and Pascal name."""

#: extension -> text
NESTED = {
    "rs": '''use std::{fmt, io::Write};
use a::b as other;
pub trait Shape { fn area(&self, scale_by: f64) -> f64; fn name_of(&self) -> String { let (left, right) = (1, 2); let mut count_it = 0; left } type Item; }
impl<T: Clone, U> Shape for Holder<T, U> {
    pub fn Qs<'a, K>(key_one: &'a K, (px, py): (i32, i32), mut total_sum: HashMap<K, Vec<U>>) -> Self { const INNER_MAX: u8 = b'x'; static mut COUNTER: u32 = 1; let Some(found_it) = x else { return }; match x { _ => {} } }
    type Item = u8;
}
pub(crate) struct QP<K, V> { pub first_key: K, second_map: HashMap<K, V>, pub(crate) third_one: Option<[u8; 4]> }
enum State { OpenNow, Closed { reason_code: u8 } }
// fn hidden_one() {}
/* struct Gone { a: u8 } */
fn Qs() { let text_value = "fn inside() { let zz = 1; }"; let c = '{'; }
fn closures() { let add_up = items.fold(0, |acc_sum: u64, (aa, bb): &(u8, u8)| acc_sum | aa); let keep_it = move |one_item: Foo<A, B>, two, three_of: u8| one_item; }
enum Msg { #[serde] Quit, Move { pos_x: i32, #[skip] pos_y: i32 }, Raw(u8) }
fn builds(bit_a: u8) -> Point { let or_ed = bit_a | 2; match or_ed { 1 | 2 => Point { px: 1, py: bit_a | 4 }, _ => Point { px: 3, py: 4 } } }
''',
    "java": '''package a.b;
import static java.util.Map.Entry;
import java.util.*;
public class Outer<T extends Comparable<T>> extends Base implements Runnable, Other {
    private static final Map<String, List<Integer>> cacheMap = new HashMap<>(), secondMap = null;
    int ab = 1, cd = 2;
    int[] arrayField = {1, 2};
    @Override public <R> List<R> Qc(final Function<T, R> mapper, String... restArgs) throws IOException, Foo {
        for (int idx = 0, jj = 1; idx < 3; idx++) { String innerText = "class Fake {}"; }
        for (String each : list) { each.call(); }
        try (Reader rd = open()) { } catch (Exception ex) { throw new Foo(ex); }
        Runnable rr = new Runnable() { public void run() { int deepest = 1; } };
        int first = 1, second = 2;
        return null;
    }
    Outer(int startSize) { this.x = startSize; }
    class QP { Object inner; interface Deep { long LIMIT_ONE = 5, LIMIT_TWO = 6; void doIt(int howMany); } }
    enum Color { RED, GREEN; private int shade; int shadeOf() { return shade; } }
    record Point(int posX, int posY) { }
}
''',
    "c": '''#include "my dir/file.h"
#define MAX(a, b) ((a) > (b) ? (a) : (b))
typedef int (*callback_fn)(int);
typedef struct node { int value_of; struct node *next_node; } node_t;
typedef unsigned char byte_t;
typedef node_t other_t;
enum color_kind { RED_ONE, GREEN_ONE };
static const char *names_of[] = { "a", "b" };
int global_count = 0, other_count;
extern int proto_call(int first_arg, char *second_arg, double third_arr[3]);
int *pointer_fn(void);
static int Qs(struct node *list_head, int n_items) {
    unsigned long total_sum = 0;
    int *cursor_ptr = list_head;
    int grid[3][4];
    for (int step_i = 0; step_i < 3; step_i++) { double inner_val; inner_val = call(step_i, total_sum); }
    if (total_sum == 3) return Qs(list_head, 3);
    return 0;
}
''',
    "cpp": '''#include <map>
namespace outer {
class QP : public Base {
public:
    QP(int width_px);
    explicit QP(const std::string &label_text) : label(label_text) { int init_count = 0; }
    ~QP();
    int size() const { return size_; }
    std::map<std::string, int> table_of;
    static const int kLimit = 5;
private:
    int size_ = 0; char *raw_buf;
};
struct Point3 { double px_, py_; };
enum class Mode { Fast, Slow };
std::vector<int> Qs(const std::vector<int> &input_list, int count_of) { std::vector<int> result_list; auto it_first = result_list.begin(); return result_list; }
void outer::QP::resize(int new_width) { std::string tmp_name = "x;{"; }
}
''',
    "js": '''import def, { alpha as beta, gamma } from "mod";
import * as ns from 'other';
export default class QP extends Base { static count = 0; #secret = 1; constructor(first, second) { super(); } async loadAll(page, size = 3) { const { aa, bb } = page, [cc] = size; } get total() { return 1; } }
export async function Qc(name, options) { let xx = 1, yy = `t ${xx}`, zz; for (let ii = 0; ii < 3; ii++) { if (ii) { call(ii); } } for (const item of list) { work(item); } }
const handler = (event, ctx) => { var inner = 1 };
const obj = { method(arg) { return arg }, other: function named(param) {} }
class Inner { run(x1) {} }
while (going) { step() }
''',
    "ts": '''import type { TypeA } from './a';
import { fnB, type TypeC } from './b';
export interface Props { name: string; call(value: number): void }
export abstract class Abs { abstract area(scale: number): number; run(): void {} }
class QP<T> implements Base { private readonly items: Map<string, T> = new Map(); constructor(private store: Store, public size = 3) {} find<K>(key: K, ...rest: string[]): T | undefined { const found: T = this.items.get(key); return found } }
function Qc({ left, right }: Pair, optional?: number): Promise<void> { return null }
export const arrow = async (input: string, done = false): Promise<string> => { let out = input; return out };
enum Kind { One, Two }
''',
    "go": '''package main
import (
    "fmt"
    nh "net/http"
)
import io "io/ioutil"
type Server struct { Addr string; count int }
type ( Alias = int; Handler func(w Writer, req *Request) error )
const ( maxSize = 1; minSize = 2 )
const single, double = 1, 2
var globalOne, globalTwo int = 1, 2
var ( cacheMap map[string]int )
func (srv *Server) QP(ctx context.Context, aa, bb int, opts ...Option) (result int, err error) {
    Qs, other := 1, 2
    if val, ok := cacheMap["x"]; ok { inner := val }
    for idx, item := range list { _ = item }
    go func(job string) { }("x")
    return Qs, nil
}
func Generic[T any](value T) T { return value }
''',
    "rb": '''require 'net/http'
require_relative "lib/helper"
module Outer::Inner
  class QP < Base
    MAX_SIZE = 10
    Other2 = 1
    attr_reader :name
    def self.Qs(first_arg, second = 1, *rest, key: 2, needed:)
      @cache = other = 3
      value ||= 4
      if value == 3 then total = 5 end
    end
    def plain arg_one, opt = 2
      x = { a: 1 }
    end
    def valid?; true; end
    def name=(val)
      @name = val
    end
  end
end
# def hidden; end
=begin
class Gone
=end
''',
    "php": '''<?php
namespace App\\Models;
use App\\Base\\Model, App\\Other as Alias;
use function App\\helper;
abstract class QP extends Model implements Foo {
    use SomeTrait;
    const MAX_ONE = 1, MAX_TWO = 2;
    public static $shared = [1, 2], $second;
    private ?string $label = null;
    public function __construct(private int $age, string $name = "x", array ...$rest) { static $calls = 0, $more; $local = 1; }
    abstract protected function doIt(int $howMany): void;
}
trait Sharing { }
function Qc(&$ref, $plain) { $fn = function ($inner) use ($plain) { }; $arrow = fn($zz) => $zz; }
class Tiny { public $x; function one_of($y, $zed) { static $k = 1; } }
''',
    "cs": '''using System;
using static System.Math;
using Alias = System.Collections.Generic;
namespace App.Core {
  public class QP<T> : Base where T : class {
    private readonly Dictionary<string, int> mapOf = new(), otherMap;
    public string Name { get; set; } = "x";
    public int Size => 3;
    public event EventHandler Changed;
    public QP(int startSize) : base(startSize) { var local = 1; }
    public async Task<List<T>> Qc<K>(K keyOne, params string[] rest) where K : new() { int first = 1, second = 2; for (int idx = 0; idx < 3; idx++) { } foreach (var item in list) { } return null; }
    int Local() { int Inner(int deep) => deep; return Inner(1); }
  }
  public delegate void Handler(object sender);
  struct Vec { public double PosX; }
  record Person(string FirstName);
  enum Kind { One, Two }
  interface IThing { void DoIt(int howMany); string Title { get; } }
}
''',
    "swift": '''import Foundation
import class UIKit.UIView
public class QP: Base {
    let maxSize = 1, other = 2
    private let hidden = 3
    static var shared: QP = QP()
    init(with name: String, count: Int = 3) { var inner = 1 }
    func Qc<T>(_ item: T, at index: Int) -> Bool { if let found = item { let (aa, bb) = (1, 2) } ; guard let gg = item else { return false }; return true }
    var computed: Int { return 1 }
}
protocol Shape { func area(scale: Double) -> Double; var sides: Int { get } }
enum State: Int { case open, closed
    indirect case custom(Int) }
extension QP { func extra() {} }
struct Pt { var px: Int }
''',
    "kt": '''package a.b
import java.util.List
import java.io.* 
import kotlin.math.max as bigger
@Anno data class QP(val userName: String, private var age: Int = 3, extra: List<Int>) : Base(userName), Other {
    val MAX_ONE = 1
    private val HIDDEN_ONE = 2
    const val TOP_ONE = 3
    var counter: Int = 0
    val (aa, bb) = pair
    override suspend fun <T> String.Qc(item: T, vararg rest: Int): Boolean { val local = 1; return true }
    companion object { val inner = 1 }
}
enum class Color(val rgb: Int) { RED(1), GREEN(2); fun shade(by: Int) = by }
interface Shape { fun area(scale: Double): Double }
object Single { }
typealias Names = List<String>
fun topLevel(block: (Int) -> Unit, name: String = "x") = 1
''',
    "py": '''from __future__ import annotations
import os.path as osp, sys.path, json
from .local import helper_one, other_two
from .. import parent_mod as pm, sibling_mod
from typing import List as Lst
from mod_name import *
from . import *
import aliased_only as ao
class QP(Base):
    attr_one: int = 1
    async def Qs(self, first_arg: int, *rest_args: str, key_only: bool = True, **opts: int):
        left_side = right_side = 2
        aa, bb = 1, 2
        def inner_fn(plain, typed_one: "List[int]" = None): return plain
        self.value = lambda xx: xx
''',
}
