"""What the language itself answers: names every object has, and results of common core methods.

All tables are small constants; a project's larger inventories are parameters.
"""

from __future__ import annotations

# Methods of every object.
OBJECT_METHODS = "class inspect to_s nil? is_a? kind_of? instance_of? respond_to? send public_send __send__ object_id hash dup clone freeze frozen? tap then yield_self itself method methods public_methods private_methods singleton_methods singleton_class instance_variable_get instance_variable_set instance_variable_defined? instance_variables instance_eval instance_exec extend equal? eql? == != === =~ !~ ! <=> define_singleton_method display enum_for to_enum public_method singleton_method remove_instance_variable __id__".split()
# Functions callable without a receiver.
KERNEL_FUNCTIONS = "puts print p pp raise fail require require_relative load loop lambda proc format sprintf printf rand srand sleep gets exit abort at_exit binding block_given? caller caller_locations catch throw eval freeze Integer Float String Array Hash Rational Complex warn system exec spawn fork open putc readline readlines select trap test autoload global_variables local_variables __method__ __dir__ attr_reader attr_writer attr_accessor include extend prepend private public protected".split()
# Methods of every class object.
CLASS_METHODS = "new allocate superclass subclasses name to_s ancestors instance_methods instance_method method_defined? public_method_defined? private_method_defined? protected_method_defined? public_instance_methods private_instance_methods public_instance_method const_get const_set const_defined? const_missing constants const_source_location class_eval module_eval class_exec module_exec class_variable_get class_variable_set class_variable_defined? class_variables define_method alias_method remove_method undef_method remove_const include? included_modules include prepend attr_reader attr_writer attr_accessor attr private public protected module_function private_constant public_constant private_class_method public_class_method instance_variable_get < <= > >= refine using attached_object deprecate_constant".split()
# Constants that are always there.
CORE_CONSTANTS = "Object BasicObject Kernel Module Class Comparable Enumerable Enumerator NilClass TrueClass FalseClass Integer Float Numeric Rational Complex String Symbol Array Hash Range Regexp MatchData Proc Method UnboundMethod Binding Exception StandardError ArgumentError TypeError NameError NoMethodError RuntimeError FrozenError KeyError IndexError StopIteration RangeError FloatDomainError ZeroDivisionError IOError EOFError SystemCallError Errno LoadError NotImplementedError ScriptError SyntaxError SecurityError SystemExit SystemStackError NoMemoryError SignalException Interrupt RegexpError EncodingError FiberError ThreadError LocalJumpError UncaughtThrowError ClosedQueueError NoMatchingPatternError NoMatchingPatternKeyError Struct Data Time Random Process Signal Thread Mutex Queue SizedQueue ConditionVariable Fiber Ractor IO File Dir FileTest GC ObjectSpace Marshal Math Encoding ENV ARGV ARGF STDIN STDOUT STDERR RUBY_VERSION RUBY_PLATFORM RUBY_ENGINE RUBY_PATCHLEVEL DATA TOPLEVEL_BINDING Warning TracePoint RubyVM Refinement Set".split()
# Top constants of libraries that come with the language.
LIBRARY_CONSTANTS = "FileUtils Digest JSON SecureRandom Logger Date DateTime URI Net OpenStruct Pathname ERB YAML CSV StringIO StringScanner Tempfile BigDecimal Forwardable SingleForwardable Singleton Observable Timeout Benchmark OpenSSL Zlib Socket TCPSocket TCPServer UDPSocket UNIXSocket Monitor MonitorMixin Open3 Shellwords Etc OptionParser PP Psych Ripper RbConfig Gem Bundler DRb ObjectSpace Matrix Prime Base64 Find Resolv IPAddr Readline Reline IRB Coverage Delegator SimpleDelegator DelegateClass WeakRef TSort PTY Syslog Fiddle Racc Rake Minitest Test English Tmpdir RDoc T".split()
# What test frameworks make every object answer.
MOCK_METHODS = "stub stubs expects unstub should should_not should_receive stub_chain must_equal must_be wont_equal expect_any_instance_of any_instance mocha".split()
# Modules of signature libraries, which add nothing a class could be missing.
SIGNATURE_MODULES = ("Kernel", "T::Sig", "T::Helpers", "T::Generic")
#: Superclass names that add nothing a class could be missing.
ROOTS = ("Object", "BasicObject")
CORE_TYPES = ("Integer", "Float", "String", "Symbol", "Array", "Hash", "nil", "bool")

# Calls that leave what their receiver holds alone and do not answer the receiver itself.
KEEPS_ELEMENTS = frozenset("first last size length count empty? any? all? none? one? include? member? key? has_key? value? has_value? min max sum join index find_index rindex [] at dig fetch values_at keys values map collect flat_map filter_map select filter reject find detect find_all sort sort_by min_by max_by group_by partition uniq compact flatten reverse take drop take_while drop_while zip reduce inject + - & | == != nil? is_a? kind_of? instance_of? frozen? to_s inspect hash dup transform_values transform_keys merge each_with_object tally sample".split())
# Iterations that answer their receiver; as a statement nobody reads that.
ITERATIONS = frozenset("each each_with_index each_pair each_key each_value reverse_each each_index".split())
# Without a block these answer an enumerator.
NEEDS_BLOCK = {"Array": "each each_with_index map collect select filter reject flat_map sort_by find_index".split(), "Hash": "each each_pair map".split(), "Integer": ["times"]}
# With a block these answer what the block makes of it, or their receiver.
NEEDS_NO_BLOCK = {"Hash": ["to_h", "merge"], "String": ["split", "chars", "lines"]}

# Class, method, least and most arguments (- for no bound), result.  A result is a type, or a rule:
# self (the receiver's type), elem, keys, values (what it holds), plus, push, merge (what both hold), flatten, and
# number, power, digits, clamp, gsub (by the arguments).
_RESULTS = """
Integer + 1 1 number|Integer - 1 1 number|Integer * 1 1 number|Integer / 1 1 number|Integer % 1 1 number|Integer ** 1 1 power|Integer to_s 0 1 String|Integer to_i 0 0 Integer|Integer to_f 0 0 Float|Integer abs 0 0 Integer|Integer succ 0 0 Integer|Integer pred 0 0 Integer|Integer zero? 0 0 bool|Integer even? 0 0 bool|Integer odd? 0 0 bool|Integer positive? 0 0 bool|Integer negative? 0 0 bool|Integer chr 0 1 String|Integer gcd 1 1 Integer|Integer clamp 1 2 clamp|Integer == 1 1 bool|Integer != 1 1 bool|Integer < 1 1 bool|Integer <= 1 1 bool|Integer > 1 1 bool|Integer >= 1 1 bool
Float + 1 1 number|Float - 1 1 number|Float * 1 1 number|Float / 1 1 number|Float % 1 1 number|Float ** 1 1 power|Float to_s 0 0 String|Float to_i 0 0 Integer|Float to_f 0 0 Float|Float abs 0 0 Float|Float nan? 0 0 bool|Float zero? 0 0 bool|Float positive? 0 0 bool|Float negative? 0 0 bool|Float round 0 - digits|Float floor 0 1 digits|Float ceil 0 1 digits|Float == 1 1 bool|Float != 1 1 bool|Float < 1 1 bool|Float <= 1 1 bool|Float > 1 1 bool|Float >= 1 1 bool
String + 1 1 String|String * 1 1 String|String upcase 0 - String|String downcase 0 - String|String capitalize 0 - String|String strip 0 0 String|String lstrip 0 0 String|String rstrip 0 0 String|String chomp 0 1 String|String chop 0 0 String|String reverse 0 0 String|String length 0 0 Integer|String size 0 0 Integer|String to_sym 0 0 Symbol|String to_s 0 0 String|String to_i 0 1 Integer|String to_f 0 0 Float|String empty? 0 0 bool|String include? 1 1 bool|String split 0 2 Array[String]|String chars 0 0 Array[String]|String lines 0 - Array[String]|String start_with? 0 - bool|String end_with? 0 - bool|String intern 0 0 Symbol|String sub 1 2 String|String gsub 1 2 gsub|String == 1 1 bool|String != 1 1 bool
Symbol to_s 0 0 String|Symbol to_sym 0 0 Symbol|Symbol length 0 0 Integer|Symbol size 0 0 Integer|Symbol name 0 0 String|Symbol == 1 1 bool
Array length 0 0 Integer|Array size 0 0 Integer|Array count 0 1 Integer|Array empty? 0 0 bool|Array any? 0 1 bool|Array all? 0 1 bool|Array none? 0 1 bool|Array join 0 1 String|Array reverse 0 0 self|Array compact 0 0 self|Array uniq 0 0 self|Array sort 0 0 self|Array sort_by 0 0 self|Array shuffle 0 - self|Array to_a 0 0 self|Array each 0 0 self|Array each_with_index 0 - self|Array include? 1 1 bool|Array == 1 1 bool|Array first 0 1 elem|Array last 0 1 elem|Array min 0 1 elem|Array max 0 1 elem|Array pop 0 1 elem|Array shift 0 1 elem|Array push 0 - push|Array << 1 1 push|Array concat 0 - plus|Array + 1 1 plus|Array - 1 1 self|Array flatten 0 1 flatten
Hash keys 0 0 keys|Hash values 0 0 values|Hash length 0 0 Integer|Hash size 0 0 Integer|Hash count 0 1 Integer|Hash empty? 0 0 bool|Hash any? 0 1 bool|Hash key? 1 1 bool|Hash has_key? 1 1 bool|Hash include? 1 1 bool|Hash member? 1 1 bool|Hash value? 1 1 bool|Hash has_value? 1 1 bool|Hash merge 0 - merge|Hash each 0 0 self|Hash each_pair 0 0 self|Hash to_h 0 0 self|Hash to_a 0 0 Array
nil to_s 0 0 String|nil to_a 0 0 Array|nil to_i 0 0 Integer|nil inspect 0 0 String|nil nil? 0 0 bool
bool ! 0 0 bool|bool & 1 1 bool|bool ^ 1 1 bool|bool to_s 0 0 String|bool inspect 0 0 String
"""
#: Rules told by what collections hold.
BY_CONTENT = ("elem", "keys", "values", "plus", "push", "merge")
#: Rules that read the arguments; where a call hides those (a splat, keywords) nothing is known.
BY_ARGUMENTS = ("number", "power", "digits", "clamp", "gsub", "elem", "plus", "push", "merge", "flatten")


def core_results() -> list[tuple[str, str, int, int | None, str, bool | None]]:
    """(class, method, least, most, result, block): ``block`` tells with or without which the result holds; null for both."""
    out = []
    for line in _RESULTS.strip().split("\n"):
        for row in line.split("|"):
            kind, name, least, most, result = row.split(" ")
            block = True if name in NEEDS_BLOCK.get(kind, ()) else False if name in NEEDS_NO_BLOCK.get(kind, ()) else None
            out.append((kind, name, int(least), None if most == "-" else int(most), result, block))
    return out
