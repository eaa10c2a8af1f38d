"""Names that the assembly tokenizer and the flow graph know."""

from __future__ import annotations


def _span(prefix: str, lo: int, hi: int, suffix: str = "") -> list[str]:
    return [f"{prefix}{i}{suffix}" for i in range(lo, hi + 1)]


_X86 = [r + s for r in "abcd" for s in ("h", "l", "x")] + [p + r for p in ("e", "r") for r in ("ax", "bx", "cx", "dx", "si", "di", "bp", "sp", "ip")] + ["si", "di", "bp", "sp", "eflags"] + [s + "s" for s in "cdefgs"]
_X86 += ["cr0", *_span("cr", 2, 4), *_span("dr", 0, 3), "dr6", "dr7", *_span("st", 0, 7), *_span("xmm", 0, 31), *_span("ymm", 0, 31)] + [x for s in ("", "d", "w", "b") for x in _span("r", 8, 15, s)]
_ARM = _span("r", 0, 15) + ["sp", "lr", "pc", "cpsr", "spsr", "fpscr", "xzr", "wzr", "fp", "ip"] + _span("x", 0, 30) + _span("w", 0, 30) + _span("v", 0, 31) + _span("q", 0, 15) + _span("d", 0, 31) + _span("s", 0, 31)
_MIPS = _span("$", 0, 31) + ["$" + n for n in (*_span("v", 0, 1), *_span("a", 0, 3), *_span("t", 0, 9), *_span("s", 0, 7), *_span("k", 0, 1), *_span("f", 0, 31), "zero", "at", "gp", "sp", "fp", "ra", "hi", "lo")]
_RISCV = _span("x", 0, 31) + ["zero", "ra", "gp", "tp"] + _span("t", 0, 6) + _span("s", 0, 11) + _span("a", 0, 7) + _span("f", 0, 31) + _span("ft", 0, 11) + _span("fs", 0, 11) + _span("fa", 0, 7)

REGISTERS = sorted({*_X86, *_ARM, *_MIPS, *_RISCV})
SIZES = ["byte", "dword", "ptr", "qword", "word"]
#: Instructions that mark a shingle as distinctive, by what they are for.
RARE = sorted("clts cpuid emms hlt int invd invlpg iret iretd iretq lgdt lidt lldt lmsw ltr monitor mwait rdmsr rdpmc rdrand rdseed rdtsc rdtscp rsm sgdt sidt sldt str syscall sysenter sysexit sysret ud2 vmcall vmlaunch vmresume vmxoff wbinvd wrmsr xgetbv".upper().split())
#: Tokens of which a shingle may consist and say little.
COMMON = sorted("add and call cmp dec imm inc jmp label lea mem_size mov neg nop not or pop push reg ret retn sal sar shl shr sub test xor".upper().split())
EXITS = ["RET", "RETF", "RETN"]
BRANCHES = sorted("call jmp loop loope loopne loopnz loopz jcxz jecxz jrcxz ja jae jb jbe je jg jge jl jle jne jno jnp jns jnz jo jp js jz".upper().split() + EXITS)
